"""p1: readers, features, exact blocking, mixture, and edge cases."""

import random
import re
from datetime import date, timedelta

import numpy as np
import pytest

from evidex.llm import matching as M

REGIONS = [("Kest Gulf", "Sarrah"), ("Marl Highlands", "Aurel"), ("Upper Brannock", "Orvania"), ("Westermark", "Kelland")]


@pytest.mark.parametrize(("text", "place", "region"), [
    ("vic. Kunzynminster (Marl Highlands)", "kunzynminster", "marl highlands"), ("Kest Gulf, about 7 km off Sanjamminster", "sanjamminster", "kest gulf"), ("SILMOLDALE, ORV", "silmoldale", ""),
    ("road between Stovskyrport and the Upr. Brannock line", "stovskyrport", "upper brannock"), ("over Bavtilwick harbour; Orvania", "bavtilwick", ""), ("4 mi SE of BYVJIXWICK, Westermark", "byvjixwick", "westermark"),
    ("Turry- rfield, Kest Gulf", "turryrfield", "kest gulf"), ("Halflámhurst", "halflamhurst", ""), ("restricted area", "", ""), ("low orbit", "", ""), ("the Kest Gulf", "", "kest gulf"), (None, "", ""), ("", "", ""),
])
def test_places(text, place, region):
    assert M.read_place(text, M.Regions(REGIONS)) == (place, region)


PHRASES = M.Phrases("cone bell cigar disc oval ring glow dome".split(), "chalk-white silvery pearly ivory brass-coloured violet dull grey".split())


@pytest.mark.parametrize(("title", "account", "phrase", "want"), [
    ("Case file", "A wavering column dropped. Object: chalk-white cone. Duration about 10 minutes.", None, (["cone"], ["chalk-white"], [600], [])),
    ("Silvery bell sighting", "A pearly cigar circled. Estimated height 15,500 feet, silvery bell, 20 seconds.", None, (["bell"], ["silvery"], [20], [15500])),
    ("Memorandum, unidentified ring", "violet ring in view for about 60 minutes. At 34,000 feet a dull grey disc hovered for 2 hours.", None, (["ring"], ["violet"], [3600, 7200], [34000])),
    (None, "A pearly cigar and a violet ring crossed.", None, (["cigar", "ring"], ["pearly", "violet"], [], [])),
    ("Report of pearly glow", "", "dull grey dome", (["dome"], ["dull grey"], [], [])), (None, None, None, ([], [], [], [])), ("Case file", "no nouns", "", ([], [], [], [])),
])
def test_accounts(title, account, phrase, want):
    assert M.read_account(title, account, PHRASES, phrase) == want


def test_known_phrases(spark):
    df = spark.createDataFrame([("dull grey cone",)] * 50 + [("Pearly bell",)] * 50 + [(None,), ("",), ("odd thing",)], "p string")
    known = M.known_phrases(df, "p", 0.1)
    assert known.heads == {"cone", "bell"} and known.words == {"dull", "grey", "pearly"}
    assert M.known_phrases(df.limit(0), "p").heads == set()


SHAPES, COLOURS = ["disc", "cone", "ring", "oval", "bell", "dome"], ["dark", "pale", "ivory", "amber", "violet"]
MADE = M.Phrases(SHAPES, COLOURS)


def make(n, seed, spark, places=None, wrong=0.0):
    """Sightings with an incident and a record each, noise on both, and true pairs; a share `wrong` of the records tells another colour or shape."""
    r = random.Random(seed)
    places = places or ["".join(r.choices("bcdfglmnprst", k=4)) + e for e in ("wick", "haven", "minster", "ford", "holm") for _ in range(8)]
    a, b, truth = [], [], set()
    for i in range(n):
        p, d = r.choice(places), date(1950, 1, 1) + timedelta(days=r.randrange(25_000))
        shape, colour = r.choice(SHAPES), r.choice(COLOURS)
        typo = p if r.random() < 0.8 else p[:3] + p[4:]
        dated = [d.isoformat(), f"{d.day} {d:%B} {d.year}", f"{d:%B} {d.year}", "unknown"][r.choices(range(4), [5, 3, 1, 1])[0]]
        a.append((f"c{i}", f"near {p}, Westermark", d.isoformat(), f"{colour} {shape}", f"It rose. The {colour} {shape} stayed in view 20 seconds."))
        if r.random() < wrong:
            shape, colour = (shape, r.choice(COLOURS)) if r.random() < 0.5 else (r.choice(SHAPES), colour)
        b.append((f"r{i}", f"{typo.upper()}, KEL", dated, f"Report of {colour} {shape}", f"Object: {colour} {shape}. Duration 20 seconds."))
        truth.add((f"c{i}", f"r{i}"))
    return _left(spark, a), _right(spark, b), truth


def _left(spark, rows):
    df = spark.createDataFrame(rows, "case_id string, loc string, dated string, phrase string, acc string")
    return M.prepare(df, "a", {"id": "case_id", "place": "loc", "dated": "dated", "phrase": "phrase", "account": "acc"}, REGIONS, MADE)


def _right(spark, rows):
    df = spark.createDataFrame(rows, "key string, loc string, dated string, title string, acc string")
    return M.prepare(df, "b", {"id": "key", "place": "loc", "dated": "dated", "title": "title", "account": "acc"}, REGIONS, MADE)


def test_finds_true_pairs_with_calibrated_confidence(spark):
    x, y, truth = make(400, 1, spark, wrong=0.1)
    rows = M.match(x, y).collect()
    got = {(r.a, r.b) for r in rows if r.confidence >= 0.5}
    assert len(got & truth) / len(truth) >= 0.9 and len(got & truth) / len(got) >= 0.9
    assert len(rows) > 1.2 * len(truth)  # the mixture, not the blocking, tells matches from the rest
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):
        part = [r for r in rows if lo <= r.confidence < hi]
        assert abs(sum(r.confidence for r in part) / len(part) - sum((r.a, r.b) in truth for r in part) / len(part)) <= 0.1


def test_contradiction_in_object_and_colour_is_rejected(spark):
    x, y, truth = make(400, 5, spark)
    a = [("cx", "near Planthaven, Westermark", "1980-05-05", "amber disc", "The amber disc stayed."), ("cy", "near Planthaven, Westermark", "1970-05-05", "amber disc", "The amber disc stayed.")]
    b = [("rx", "Planthaven", "1980-05-05", "Report of violet cone", "Object: violet cone."), ("ry", "Planthaven", "1970-05-05", "Report of violet disc", "Object: violet disc.")]
    got = {(r.a, r.b): r.confidence for r in M.match(x.unionByName(_left(spark, a)), y.unionByName(_right(spark, b))).collect()}
    assert got["cx", "rx"] < 0.5 < got["cy", "ry"]


def test_hot_place_is_spread_and_loses_no_pair(spark, monkeypatch):
    x, y, _ = make(150, 6, spark, places=["hotsprings"])
    rows = M.settle_places(x.unionByName(y))
    sides = rows.filter("side = 'a'"), rows.filter("side = 'b'")
    whole = sorted(map(tuple, M.candidate_pairs(*sides).select("a", "b", "f_time").collect()))
    monkeypatch.setattr(M, "SPREAD", 5)
    assert sorted(map(tuple, M.candidate_pairs(*sides).select("a", "b", "f_time").collect())) == whole and len(whole) > 1000


def test_blocking_loses_no_compatible_pair(spark):
    x, y, _ = make(120, 2, spark)
    rows = M.settle_places(x.unionByName(y))
    a, b = rows.filter("side = 'a'").collect(), rows.filter("side = 'b'").collect()
    pairs = [(r.a, r.b) for r in M.candidate_pairs(rows.filter("side = 'a'"), rows.filter("side = 'b'")).collect()]

    def fits(p, q):
        if p.place != q.place or not p.place:
            return False
        if not p.prec or not q.prec:
            return bool(set(p.heads) & set(q.heads) or set(p.colours) & set(q.colours))
        return p.lo <= q.hi + 1 and q.lo <= p.hi + 1

    assert len(pairs) == len(set(pairs)) and {(p.id, q.id) for p in a for q in b if fits(p, q)} < set(pairs)


def test_edge_cases(spark):
    x, y, _ = make(3, 3, spark)
    assert M.match(x.limit(0), y).count() == 0 and M.match(x, y.limit(0)).count() == 0
    left = spark.createDataFrame([(None, "near Xxxxford", "1990-01-01", None), ("c", None, None, None), ("d", "near Abcdford, Westermark", "1990-05-05", 1), ("d", "near Abcdford, Westermark", "1990-05-05", 1)], "case_id string, loc string, dated string, place int")
    right = spark.createDataFrame([("r", "ABCDFORD", "6 May 1990"), ("s", None, "1990-05-05")], "key string, loc string, dated string")
    a = M.prepare(left, "a", {"id": "case_id", "place": "loc", "dated": "dated"}, REGIONS, MADE)
    b = M.prepare(right, "b", {"id": "key", "place": "loc", "dated": "dated"}, REGIONS, MADE)
    assert [(r.a, r.b) for r in M.match(a, b).collect()] == [("d", "r")]


def test_mixture_column_equals_one_by_one(spark):
    r = np.random.default_rng(0)
    x = np.where(r.random((200, 7)) < 0.2, -1.0, np.round(np.where(r.random((200, 1)) < 0.5, r.normal(0.9, 0.1, (200, 7)), r.normal(0.2, 0.2, (200, 7))).clip(0, 1), 1))
    df = spark.createDataFrame([[float(v) for v in row] + [float(row.mean() > 0.5), i % 3] for i, row in enumerate(x)], [*M.FEATURES, "g", "stratum"])
    sums = M.sufficient_sums(df, "g")
    assert sorted(sums) == [0, 1, 2]
    mix = M.Mixture(sums[0])
    for q in df.withColumn("p", mix.column()).collect():
        assert abs(q.p - mix.likelihood(q.asDict())) < 1e-9


def mixture_rows(seed):
    r = np.random.default_rng(seed)
    return [[float(v) for v in row] + [float(row.mean() > 0.5), i % 3] for i, row in enumerate(np.where(r.random((90, 7)) < 0.2, -1.0, r.random((90, 7))))]


def test_code_of_posteriors_is_small_and_the_same_in_all_rounds(spark):
    codes = []
    for seed in (1, 2):
        df = spark.createDataFrame(mixture_rows(seed), [*M.FEATURES, "g", "stratum"])
        plan = df.withColumn("p", M.Mixture(M.sufficient_sums(df, "g")[0]).column()).select("p", "stratum").filter("p >= 0.01")._jdf.queryExecution().executedPlan()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        codes.append(getattr(debug, "MODULE$").codegenString(plan))
    # methods over 8,000 bytes are never compiled by JVMs
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", codes[0])) < 8000
    source = [c[c.index("Generated code:") :] for c in codes]
    assert source[0] == source[1]


def test_transitive_equals_one_by_one_and_joins_nothing(spark):
    r = random.Random(4)
    pairs = [(f"a{i}", f"b{j}", round(r.random(), 3), *(f() for _ in "ab" for f in (lambda: r.choice([None, 5, 9]), lambda: 9, lambda: r.choice([None, 1, 2]), lambda: r.choice([None, 1, 2])))) for i in range(12) for j in range(12) if r.random() < 0.5]
    names = [f"{c}_{s}" for s in "ab" for c in M.ABOUT]
    df = spark.createDataFrame(pairs, "a string, b string, post double, " + ", ".join(f"{n} int" for n in names))
    rows = [dict(zip(df.columns, p, strict=True)) for p in pairs]

    def keep(p, own, other):
        best = max((q for q in rows if q[own] == p[own]), key=lambda q: (q["post"], q[other]))
        if best[other] == p[other]:
            return 1.0
        x, y = ({c: q[f"{c}_{other}"] for c in M.ABOUT} for q in (p, best))
        known = lambda c: x[c] is not None and y[c] is not None
        apart = None if not known("lo") else x["lo"] > y["hi"] + 1 or y["lo"] > x["hi"] + 1
        clash = any(known(c) and x[c] != y[c] for c in ("head", "colour"))
        return 1 - best["post"] if (clash if apart is None else apart) else 1.0

    out = M.transitive(df)
    got = {(q.a, q.b): q.post for q in out.collect()}
    assert len(got) == len(rows)
    for p in rows:
        assert abs(got[p["a"], p["b"]] - p["post"] * keep(p, "a", "b") * keep(p, "b", "a")) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 2


def test_hot_keys_over_the_bound_are_whole(spark, monkeypatch):
    x, y, _ = make(60, 7, spark, places=["hotsprings"])
    rows = M.settle_places(x.unionByName(y))
    sides = rows.filter("side = 'a'"), rows.filter("side = 'b'")
    whole = sorted(map(tuple, M.candidate_pairs(*sides).select("a", "b", "f_time").collect()))
    monkeypatch.setattr(M, "SPREAD", 1)
    monkeypatch.setattr(M, "MOST_HOT", 3)
    assert sorted(map(tuple, M.candidate_pairs(*sides).select("a", "b", "f_time").collect())) == whole and whole


def test_short_cuts_of_the_readers_lose_nothing():
    r = random.Random(8)
    words = ["".join(r.choices("abc", k=r.randrange(1, 6))) for _ in range(300)]
    assert all(M._one_edit(a, b) == (M.osa(a, b, 1) <= 1) for a in words for b in words)
    read = lambda text: M.read_account(None, text, MADE)[2:]
    assert read("1234567 seconds, x12 seconds, 7_3 minutes, (4 hours) 15,500 FEET 3-ft") == ([14400], [3, 15500])
    assert read("9-minute, 2 Hours; 12 ſeconds") == ([12, 540, 7200], [])
    known = M.Regions(REGIONS)
    assert [known.find(p) for p in ("kest gulf", "kst gulf", "kestgulf", "k gulf", "wsetermark", "westermar", "orv", "orvaniaa", "kelland", "elsewhere", "x")] == ["kest gulf"] * 4 + ["westermark"] * 2 + [""] * 3 + [None, None]
