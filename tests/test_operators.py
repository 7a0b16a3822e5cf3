"""Operators of the core: hand cases, brute force, nulls, ties, repeats and empty tables."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions import values as V
from evidex.operators import documents as D
from evidex.operators import evidence as E
from evidex.operators import linking as L
from evidex.operators import matching_rules as M
from evidex.operators import relational as R
from evidex.operators import retrieval as Q
from evidex.plans.intent import plan_question
from evidex.sources import manifest, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# --- text -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b"), [("bui l ding.", "building."), ("to l ook", "to look"), ("pane l on", "panel on"), ("the object", "the object"), ("i saw it", "i saw it"), ("di stinct", "distinct"), ("wi th", "with"), ("red orb", "red orb"), ("", ""), ("the l ight", "the light"), ("l ook", "look"), ("inte l ligence.", "intelligence."), ("mr sm ith", "mr sm ith"), ("i l i", "i l i"), ("wi th di stinct wo rds", "with distinct wo rds"), ("ab cd ef", "abcd ef"), ("1990 l ake", "1990 lake")])
def test_spaced_letters(a, b):
    assert T.join_spaced(a) == b


def test_ratio_keeps_the_popularity_rule_and_its_bound(spark):
    a = "the light moved over the ridge and back again " * 6
    b = a.replace("ridge", "bridge")
    assert T.similarity_ratio(a, b) != pytest.approx(1.0) and T.similarity_ratio("", "x") == 0.0 and T.similarity_ratio(None, "x") == 0.0
    df = spark.createDataFrame([("abcd", "abce"), ("a", "abcdefgh"), ("", "x"), (None, "x")], "a string, b string")
    for r in df.select(T.ratio("a", "b").alias("r"), T.ratio_bound("a", "b").alias("m"), "a").collect():
        assert r["a"] is None or r["r"] <= r["m"] + 1e-9


def test_small_texts(spark):
    lit = F.lit
    assert one(spark, T.slug(lit("  Ünder  the Sky! "))) == "nder-the-sky" and one(spark, T.slug(lit(None).cast("string"))) == "untitled"
    assert one(spark, T.identity("p", lit(" ab-1 "), lit("t"), lit("u"))) == "p:AB-1" and one(spark, T.identity("p", lit(""), lit("T"), lit("u"))).startswith("p:h:")
    assert one(spark, T.url_key(lit("HTTPS://A.example//x%20y//Z/"))) == one(spark, T.url_key(lit("https://a.example/xy/z?q=1#f"))) == "https://a.example/xy/z"
    assert one(spark, T.external_id(lit("Report DOW-UAP-PR019b, page 2"), lit(None).cast("string"))) == "DOW-UAP-PR019B"
    assert one(spark, T.quote_form(lit("Fl­ashed over the hor-\n izon .\n--- PAGE 3 --- Then"))) == "flashed over the horizon. then"
    assert one(spark, T.citations(lit("[ab-1] and [AB-1] [x] [c.d/2]"))) == ["AB-1", "C.D/2"]
    assert one(spark, T.pairing_tokens(lit("FBI-UAP-024 | some caption | Western event, X-1"))) == ["FBI-UAP-D024", "WESTERN EVENT", "X-1"]
    assert one(spark, T.asserted(lit("It was not a craft. The object hovered."), "hovered")) and not one(spark, T.asserted(lit("It never hovered."), "hovered"))
    assert one(spark, T.strip_fence(lit("```json\n[1]\n```"))) == "[1]" and one(spark, T.event_label(lit("Place / 1990 / a-1.pdf#ep2"))) == "Place / 1990"
    assert one(spark, T.episode_cue(lit("Shortly thereafter, the next day"))) == "new_episode" and one(spark, T.blank(lit(None).cast("string")))


def test_dates_and_numbers(spark):
    d = lambda c: str(one(spark, c))
    assert d(V.us_short_date(F.lit("5/8/26"))) == "2026-05-08" and d(V.us_short_date(F.lit("5/8/70"))) == "1970-05-08" and d(V.us_short_date(F.lit("13/8/26"))) == "None"
    assert d(V.government_date(F.lit("5/8/47"))) == "1947-05-08" and d(V.government_date(F.lit("1952"))) == "None" and d(V.government_date(F.lit("7/4/21 - 7/9/21"))) == "2021-07-04"
    day, precision = V.dated_text(F.lit("March 5-12, 1990"))
    assert (d(day), d(precision)) == ("1990-03-05", "day")
    a, b = V.question_years(F.lit("cases of the '50s"))
    assert (one(spark, a), one(spark, b)) == (1950, 1959)
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    with pytest.raises(Exception, match="longer"):
        one(spark, V.pad(F.array(F.lit(1.0), F.lit(2.0)), 1))
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "a int, b string")
    assert df.select(V.fingerprint(["a", "b"]).alias("f")).distinct().count() == 2


# --- relational -------------------------------------------------------------------------------------------------------


def test_filters_ignore_falsy_and_refuse_unknown_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert R.facets(df, k=None, v="").count() == 2 and R.facets(df, v="a").count() == 1 and R.text_search(df, " ", ["v"]).count() == 2 and R.text_search(df, "A", ["v"]).count() == 1
    with pytest.raises(KeyError):
        R.where(df, [("k", "__class__", 1)])


def test_diff_partitions_the_keys_and_finds_returns(spark, rows):
    old = spark.createDataFrame([("A", "t", "active"), ("B", "t", "active"), ("C", "t", "active"), ("E", "t", "deprecated")], "k string, t string, s string")
    new = spark.createDataFrame([("A", "t", "active"), ("B", "u", "active"), ("D", "t", "active"), ("E", "t", "active")], "k string, t string, s string")
    ch = R.diff(old, new, "k", ["t"])
    assert rows(R.returned(ch, old, new, "k", "s")) == [("A", "unchanged"), ("B", "modified"), ("C", "deprecated"), ("D", "new"), ("E", "returned")]
    assert R.diff(old.limit(0), new.limit(0), "k", ["t"]).count() == 0


def test_picks_merges_and_collisions(spark, rows):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, False)], "k string, p int, pdf boolean")
    assert rows(R.prefer(df, "k", F.col("pdf"), "p"), "k", "p") == [("a", 1), ("b", 2)]
    base, fresh = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (2, "z"), (3, "w")], "k int, v string")
    assert rows(R.merge(base, fresh, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]
    c = spark.createDataFrame([("C", "s", 1), ("C", "s", 2)], "code string, s string, o int")
    got = rows(R.extend_collisions(c, "code", "s", "o"), "code")
    assert got[0] == ("C",) and len(got[1][0]) == 5


def test_episodes_are_contiguous(spark):
    df = spark.createDataFrame([("s", i, i % 4 == 0) for i in range(12)] + [("t", 0, None)], "s string, i int, cut boolean")
    got = {(r.s, r.i): r.episode for r in R.episodes(df, ["s"], ["i"], F.col("cut")).collect()}
    assert [got["s", i] for i in range(12)] == [1] * 4 + [2] * 4 + [3] * 4 and got["t", 0] == 1


# --- joins ------------------------------------------------------------------------------------------------------------


def test_cascade_never_links_an_ambiguous_match(spark, rows):
    a = spark.createDataFrame([("1", "u", "n"), ("2", "v", "n"), ("3", None, "m"), ("4", "", None)], "i string, url string, name string")
    b = spark.createDataFrame([("x", "u", "q"), ("y", "w", "n"), ("z", "w2", "n"), ("q", "w3", "m")], "j string, url string, name string")
    got = M.cascade(a, b, "i", "j", [("url", F.col("url"), F.col("url")), ("name", F.col("name"), F.col("name"))])
    assert rows(got) == [("1", "x", "url", 1), ("2", None, "name", 2), ("3", "q", "name", 1), ("4", None, "none", 0)]


def texts(n, seed):
    r = random.Random(seed)
    words = "the light moved over a ridge near north south silent red disc hovered then left again slowly witness saw it twice".split()
    base = [" ".join(r.choices(words, k=14)) for _ in range(6)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, r.choice("ab"), None if r.random() < 0.05 else " ".join(w), r.randrange(4)))
    return out


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


def test_similar_pairs_against_brute_force(spark):
    data = texts(60, 1)
    df = spark.createDataFrame(data, "id int, g string, t string, s int").withColumn("ratio", F.lit(1)).withColumn("a", F.lit(2))
    got = {(r.a, r.b) for r in M.similar_in_group(df, "id", ["g"], "t", 0.8).collect()}
    first = {}
    for i, g, t, _ in data:
        if t:
            first.setdefault((g, t), i)
    want = {(first[g, t], i) for i, g, t, _ in data if t and first[g, t] != i}
    reps = [(i, g, t) for (g, t), i in first.items()]
    want |= {(min(i, j), max(i, j)) for i, g, t in reps for j, h, u in reps if i < j and g == h and jaccard(t, u) >= 0.3 and T.similarity_ratio(*( (t, u) if i < j else (u, t))) >= 0.8}
    assert got == want
    assert M.similar_in_group(df.limit(0), "id", ["g"], "t", 0.8).count() == 0


def alike(t, u, least):
    return t == u or (jaccard(t, u) >= 0.3 and T.similarity_ratio(t, u) >= least)


@pytest.mark.parametrize("seed", [2, 3])
def test_distinct_in_order_against_a_pass(spark, seed):
    data = [(i, g, t, s, "xy"[s % 2] if s else None) for i, g, t, s in texts(60, seed)] + [(100, "a", "short", 0, "x"), (101, "a", "short", 0, "y"), (102, None, "short", 0, "y"), (103, "a", " ", 0, "x"), (104, "a", "", 0, "x")]
    df = spark.createDataFrame(data, "id int, g string, t string, s int, d string").withColumn("pos", F.col("id"))
    got = {r.id for r in E.distinct_in_order(df, "id", ["g"], "pos", "t", 0.9, 10, [F.col("d")], 0.8).collect()}
    kept = []
    for i, g, t, _, d in data:
        repeats = lambda h, u, e: g == h and u and (t == u or len(t) >= 10 and len(u) >= 10 and (alike(t, u, 0.9) or (d == e and alike(t, u, 0.8))))  # noqa: B023, E731
        if g is None or not (t or "").strip() or not any(repeats(h, u, e) for _, h, u, e in kept):
            kept.append((i, g, t, d))
    assert got == {x[0] for x in kept}


def test_misread_spellings_of_a_sentence_are_alike(spark):
    a = "the observer watched a silver object move slowly over the northern ridge before it vanished behind the clouds near the old mill"
    w = a.split()
    b = " ".join(x.replace("e", "c", 1) if n % 3 == 0 else x for n, x in enumerate(w))
    df = spark.createDataFrame([(1, "g", a), (2, "g", b), (3, "g", "something else entirely was written on this page of the file")], "id int, g string, t string")
    assert [(r.a, r.b) for r in M.similar_in_group(df, "id", ["g"], "t", 0.9).collect()] == [(1, 2)]


def test_blocks_of_alike_texts_find_what_words_find_and_write_only_what_is_near(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "the old radar light field north".split() for b in ("", "s", "er")]
    base = [" ".join(rng.choices(words, k=rng.randint(6, 14))) for _ in range(60)]
    texts = sorted({"".join(c for c in t if rng.random() > 0.06) for t in base for _ in range(3)} | set(base))
    df = spark.createDataFrame([(n, "ab"[n % 7 == 0], t) for n, t in enumerate(texts)] + [(999, None, base[0])], "k long, g string, t string")
    cols = ["g", "ka", "kb", "ta", "tb"]
    want = {tuple(r) for r in M.similar_texts(df, ["g"], 0.8).collect()}
    wide = M._near_by_words(df, ["g"], 0.8, 0.3).count()
    for block in (16, 70, 8000):
        got = [tuple(r) for r in M.similar_texts(df, ["g"], 0.8, block=block).collect()]
        assert set(got) == want and len(got) == len(want) > 50
        assert len(want) <= M._near_in_blocks(df, ["g"], 0.8, 0.3, block).select(*cols).distinct().count() < wide / 2
    assert M.similar_texts(df.limit(0), ["g"], 0.8, block=16).count() == 0
    for t, u in zip(base, base[1:], strict=False):
        assert T.similarity_ratio(t, u) <= 2 * M.common_letters(t, u) / (len(t) + len(u)) and M.common_letters(t, t) == len(t)


def test_excerpts_of_a_file_are_not_joined_under_words(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("pairs of words")

    monkeypatch.setattr(M, "_near_by_words", fail, raising=False)
    rows = [(1, "f", 1, "a red light rose over the lake at noon"), (2, "f", 2, "a red light rose over the lake at noom"), (3, "f", 3, "a red disc fell behind the hill at dusk"), (4, None, 4, "a red light rose over the lake at noon")]
    df = spark.createDataFrame(rows, "id int, f string, pos int, t string")
    assert {r.id for r in E.distinct_in_order(df, "id", ["f"], "pos", "t", 0.9, 10).collect()} == {1, 3, 4}


def misread(r, text, share):
    """text with a letter changed in `share` of its words."""
    w = text.split()
    for n in r.sample(range(len(w)), int(share * len(w))):
        k = r.randrange(len(w[n]))
        w[n] = w[n][:k] + r.choice("qxzj\u00e9\u4e2d") + w[n][k + 1 :]
    return " ".join(w)


def test_excerpts_with_a_misread_letter_in_most_words_repeat_each_other(spark):
    r = random.Random(6)
    a = "observers watched several silver objects drifting slowly toward northern mountains before vanishing completely behind thunderclouds"
    b, c = misread(r, a, 0.8), misread(r, a, 1)
    assert jaccard(a, b) < 0.2 and T.similarity_ratio(b, a) >= 0.9 and jaccard(a, c) == 0 and 0.85 <= T.similarity_ratio(c, a) < 0.9
    data = [(1, "f", 1, a, "d"), (2, "f", 2, b, "e"), (3, "f", 3, c, "d"), (4, "f", 4, c, "e"), (5, "g", 5, b, "d"), (6, "f", 6, "a short text", "d"), (7, "f", 7, "a short texf", "d")]
    df = spark.createDataFrame(data, "id int, f string, pos int, t string, d string")
    assert {x.id for x in E.distinct_in_order(df, "id", ["f"], "pos", "t", 0.9, 40, [F.col("d")], 0.85).collect()} == {1, 4, 5, 6, 7}
    assert {x.id for x in E.distinct_in_order(df, "id", ["f"], "pos", "t", 0.9, 40).collect()} == {1, 3, 5, 6, 7}


def test_texts_alike_by_the_ratio_alone_against_brute_force(spark):
    r = random.Random(7)
    words = "observers watched several silver objects drifting slowly toward northern mountains a the of near red lights".split()
    base = [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 6, 9, 12, 15, 20, 24, 30, 30, 30, 120, 120)]
    texts = sorted({misread(r, t, s) for t in base for s in (0, 0.3, 0.6, 0.9, 1)} | {t[:-k] + " end" * k for t in base for k in (1, 2)} | {"e" * n for n in (1, 2, 30, 34, 200, 210, 700)})
    want = {least: {(i, j) for i, t in enumerate(texts) for j, u in enumerate(texts) if i < j and max(T.similarity_ratio(t, u), T.similarity_ratio(u, t)) >= least} for least in (0.92, 0.85)}
    assert all(any(jaccard(texts[i], texts[j]) < 0.3 for i, j in w) and len(w) > 30 for w in want.values())
    df = spark.createDataFrame([(n, "g", t) for n, t in enumerate(texts)], "k long, g string, t string")
    for least, block in ((0.92, 8000), (0.85, 8000), (0.85, 20)):
        got = [(x.ka, x.kb) for x in M.similar_texts(df, ["g"], least, overlap=0, block=block).collect()]
        assert set(got) == want[least] and len(got) == len(want[least])
    with pytest.raises(ValueError, match="blocks"):
        M.similar_texts(df, ["g"], 0.9, overlap=0)


@pytest.mark.parametrize("least", [0.92, 0.85])
def test_letters_lose_no_pair_of_a_large_block(least):
    r = random.Random(8)
    words = "observers watched several silver objects drifting slowly toward northern mountains a the of near red lights".split()
    a = ["".join(c for c in t if r.random() > s) for t in (" ".join(r.choices(words, k=r.randint(4, 30))) for _ in range(60)) for s in (0, 0.03, 0.06)]
    b = [misread(r, t, r.random()) for t in a]
    near = lambda t, u: 2 * M.common_letters(t, u) >= least * (len(t) + len(u))
    got = list(M.alike_by_letters(a, b, False, least))
    assert len(a) * len(b) > M._PAIRS and len(got) == len(set(got)) > 200
    assert set(got) == {(i, j) for i, t in enumerate(a) for j, u in enumerate(b) if near(t, u)}
    got = list(M.alike_by_letters(a, a, True, least))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for j, u in enumerate(a) for i, t in enumerate(a[:j]) if near(t, u)}


def test_similar_across_against_brute_force(spark):
    data = texts(60, 8)
    df = spark.createDataFrame([(i, g, t) for i, g, t, _ in data], "id int, f string, t string")
    got = {(r.a, r.b) for r in M.similar_across(df, "id", "f", "t", 0.85, 5).collect()}
    heads, first = {}, {}
    for i, g, t, _ in data:
        if t and len(t) >= 5:
            first.setdefault((t, g), i)
            heads.setdefault(t, (i, g))
    want = {(heads[t][0], i) for (t, g), i in first.items() if g != heads[t][1]}
    want |= {(min(i, j), max(i, j)) for t, (i, g) in heads.items() for u, (j, h) in heads.items() if i < j and g != h and jaccard(t, u) >= 0.3 and T.similarity_ratio(t, u) >= 0.85}
    assert got == want and len(got) > 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reconcile_against_a_pass(spark, seed):
    r = random.Random(seed)
    pick = lambda n: [None if r.random() < 0.2 else f"k{r.randrange(n)}" for _ in range(3)]
    left, right = [(i, *pick(12)) for i in range(25)], [(100 + i, *pick(12)) for i in range(20)]
    modes = ("free", "unique", "last")
    a, b = spark.createDataFrame(left, "l int, a string, b string, c string"), spark.createDataFrame(right, "r int, a string, b string, c string")
    got = {x.l: (x.r, x.level) for x in M.reconcile(a, b, "l", "r", "l", [(m, F.col(c), F.col(c), m) for m, c in zip(modes, "abc", strict=True)]).collect()}
    used, want = set(), {}
    for i, *ks in left:
        want[i] = (None, "none")
        for n, mode in enumerate(modes):
            have = [j for j, *xs in right if ks[n] and xs[n] == ks[n]]
            free = [j for j in have if j not in used]
            if len(free) == 1 and (mode == "free" or len(have) == 1):
                want[i] = (free[0], mode)
                used.add(free[0])
                break
            if len(free) > 1 or (mode == "unique" and len(have) > 1):
                want[i] = (None, "ambiguous")
                break
    assert got == want


def test_calls_handed_in(spark, rows):
    from evidex.sources import external as X

    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(1, 8)], "i int, t string")

    def call(texts, attempt):
        if attempt < 2 and len(texts[0]) == 1:
            raise X.Busy
        return [[float(len(x)), 1.0] for x in texts]

    got = {r.i: (list(r.vector), r.attempts) for r in X.embed(df.repartition(1), "i", "t", call, 2, 3, lambda s: None, 2, 5).collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7} and got[7][0] == [5.0, 1.0, 0.0] and got[1][1] in (1, 3)
    with pytest.raises(Exception, match="vectors of"):
        X.embed(df, "i", "t", lambda ts, a: [[1.0] for _ in ts], 2, 3, lambda s: None).collect()
    assert rows(X.look_up(df.unionByName(df), "t", lambda k: float(len(k)) if len(k) > 2 else None, lambda s: None)) == [("x", None), ("xx", None), ("xxxx", 4.0), ("xxxxx", 5.0), ("xxxxxx", 6.0), ("xxxxxxx", 7.0)]


def test_hybrid_classes_and_stage_a(spark, rows):
    df = spark.createDataFrame([(1, "contract"), (2, "report"), (3, "odd"), (4, None)], "i int, t string")
    rules = [("contract", "high", "contract"), ("incident", "medium", "report")]
    ask = lambda ids, texts: ["press" if i == 2 else "nonsense" for i in ids]
    assert rows(D.classify_hybrid(df, "i", "t", rules, ask, ["press"])) == [(1, "contract", "high", "rules"), (2, "press", "medium", "model"), (3, "other", "low", "rules_after_invalid"), (4, "other", "low", "rules_after_invalid")]
    prose = "The observer watched a silver object move slowly over the northern ridge before it vanished behind the clouds near the old mill. "
    pages = spark.createDataFrame([("a", 1, prose * 2), ("a", 2, ""), ("b", 1, ""), ("c", 1, "~!a|b^c " * 30), ("d", 1, prose * 2)], "f string, p int, t string")
    files = spark.createDataFrame([("a", "report"), ("d", "contract")], "f string, x string")
    got = {r.f: (r.pages, r.empty, r.document_class, r.action) for r in D.stage_a(pages, files, "f", "t", "x", rules, {"incident"}).collect()}
    assert got["a"] == (2, 1, "incident", "extract") and got["b"][3] == "failed" and got["c"][2:] == ("other", "ocr") and got["d"][3] == "source_only"


def test_linking_rules(spark, rows):
    c = spark.createDataFrame([("catalog_pairing", "m", "r", None, ""), ("catalog_pairing", "r", "m", None, ""), ("catalog_pairing", "m", "x", None, ""), ("analysis_place", "n", "C1", "strong", ""), ("analysis_place", "n", "C9", "strong", ""), ("analysis_place", "n", "C2", None, ""),
        ("series_identifier", "r", "any", None, "Western event"), ("series_identifier", "r", "caption", None, "a caption"), ("place_overlap", "C1", "C2", None, ""), ("place_overlap", "C1", "C3", None, "")], "kind string, left string, right string, band string, label string")
    files = spark.createDataFrame([("m", "media_metadata", "source_only"), ("r", "report", "extract"), ("x", "report", "source_only")], "file string, document_class string, action string")
    members = spark.createDataFrame([("E1", "r"), ("E2", "r")], "event_id string, file string")
    cases = spark.createDataFrame([("C1", "E1"), ("C2", "E2"), ("C3", "E1")], "case_id string, event_id string")
    got = rows(L.apply_rules(c, files, members, cases, {"(?i)western.*event": "western"}))
    assert got == [("analysis_of_event", "auto_supported", "n", "E1", "strong"), ("analysis_of_event", "needs_review", "n", "E2", "medium"), ("media_for_event", "auto_supported", "m", "E1", "strong"), ("media_for_event", "auto_supported", "m", "E2", "strong"), ("same_event", "review_supported", "E1", "E2", "medium"), ("same_series", "auto_supported", "r", "western", "strong")]


def test_question_contract(spark, rows):
    df = spark.createDataFrame([(1, "a", "q"), (2, "a", " "), (2, "b", "q"), (3, None, "q")], "id int, c string, t string")
    assert rows(E.contract(df, "id", "c", "t", {"a": 2, "d": 1})) == [("category", "", 1), ("category", "b", 1), ("category", "d", 0), ("duplicate_id", "2", 2), ("no_text", "2", 1), ("total", "", 4)]
    assert E.contract(df.limit(0), "id", "c", "t", {}).count() == 0


def test_paged_scan_and_assets(spark, tmp_path, rows):
    from evidex.sources import external as X

    get = lambda at, size: [{"i": k} for k in range(at, min(at + size, 43))]
    assert [r[0] for r in rows(X.paged_scan(spark, get, "i long", 10, 3))] == sorted(range(43), key=str)
    assert X.paged_scan(spark, lambda at, size: [], "i long", 10, 3).count() == 0
    path = str(tmp_path / "names.txt")
    for text in (b"old", b"new"):
        X.write_atomically(spark, path, text)
    assert open(path, "rb").read() == b"new"
    p = str(tmp_path / "assets")
    run = lambda x, day: rows(sinks.upsert_assets(spark, p, spark.createDataFrame(x, "url string, ok boolean, digest string"), day))
    assert run([("a", True, "1"), ("b", False, None)], "d1") == [("a", "stored", "1", 1, "d1"), ("b", "failed", None, 1, "d1")]
    assert run([("a", True, "1"), ("b", False, None)], "d2") == [("a", "stored", "1", 1, "d1"), ("b", "failed", None, 2, "d2")]
    assert run([("a", True, "2"), ("b", True, "3")], "d3") == [("a", "stored", "2", 1, "d3"), ("b", "stored", "3", 3, "d3")]


@pytest.mark.parametrize("seed", [4, 5])
def test_flag_in_order_against_a_pass(spark, seed):
    data = [x for x in texts(40, seed) if x[2]]
    seen = set()
    data = [x for x in data if (x[1], x[2]) not in seen and not seen.add((x[1], x[2]))]  # equal texts have a rule of their own
    df = spark.createDataFrame(data, "id int, g string, t string, s int").withColumn("pos", F.col("id"))
    got = {r.id for r in E.flag_in_order(df, "id", ["g"], "pos", "t", "s", 0.8).filter("flagged_duplicate").collect()}
    flagged = set()
    for x, (i, g, t, s) in enumerate(data):
        if i in flagged:
            continue
        for j, h, u, v in data[x + 1 :]:
            if g == h and j not in flagged and alike(t, u, 0.8):
                flagged.add(i if s < v else j)
    assert got == flagged


# --- documents --------------------------------------------------------------------------------------------------------


def test_pages(spark, rows):
    df = spark.createDataFrame([("a", "lost\n--- PAGE 1 ---\n one \n--- PAGE 3 ---\n\n"), ("b", " plain "), ("c", "  "), ("d", None)], "id string, t string")
    assert rows(D.split_pages(df, "t")) == [("a", 1, "one"), ("a", 3, ""), ("b", 1, "plain")]


def test_quality_categories(spark):
    prose = "The observer watched a silver object move slowly over the northern ridge before it vanished behind the clouds near the old mill. "
    cases = {"": "needs_ocr", prose * 2: "native_good", "Photograph of the object over the lake, June 1966, from the west shore": "native_thin", "x" + "~!a|b^c " * 20: "needs_ocr", prose + "���": "needs_ocr", prose + "a­b c­d": "needs_ocr"}
    df = spark.createDataFrame([*cases.items(), (None, "needs_ocr")], "t string, want string").withColumn("reason", F.lit("clash"))
    assert all(r.category == r.want for r in D.page_quality(df, "t").collect())


@given(st.lists(st.text(alphabet="ab ", max_size=30), max_size=8), st.integers(5, 40))
@settings(max_examples=60, deadline=None)
def test_chunks_keep_all_characters_but_marks(parts, most):
    text = "\n\n".join(parts)
    got = D.chunk(text, most)
    plain = lambda s: s.replace("\n", "")
    assert plain("".join(got)) == plain(text)
    assert all(len(plain(c)) <= most for c in got)


def test_chunk_hand_cases():
    assert D.chunk("aa\n\nbb\n\ncc", 100) == ["aa\n\nbb\n\ncc"]
    assert D.chunk("aaaa\n\nbb\n\ncccccc", 6) == ["aaaa\n\nbb", "cccccc"] and D.chunk("a" * 9 + "\n\nb", 4) == ["aaaa", "aaaa", "a", "b"]


def test_sections_and_subdivision(spark):
    pages = [(1, "x" * 10), (2, "y" * 10), (3, "z" * 10)]
    assert D.group_sections(pages, {1, 3}.__contains__, 1000) == ["--- PAGE 1 ---\n" + "x" * 10, "--- PAGE 3 ---\n" + "z" * 10]
    assert len(D.group_sections(pages, lambda n: True, 40)) == 3 and D.group_sections([], lambda n: True, 5) == []
    got, count = D.subdivide(pages, lambda s: ("max_tokens", None) if s.count("PAGE") > 1 else ("end", [s[-1]]))
    assert got == ["x", "y", "z"] and count["splits"] == 2 and count["failures"] == 0
    answers = iter([("end", None), ("end", [1])])
    assert D.subdivide([(1, "a")], lambda s: next(answers)) == ([1], {"calls": 2, "retries": 1, "splits": 0, "failures": 0})
    assert D.subdivide([(1, "a")], lambda s: ("max_tokens", None))[1]["failures"] == 1
    with pytest.raises(Exception, match="single page"):
        one(spark, D.halves(F.array(F.lit(1)))[0])


def test_routes(spark):
    df = spark.createDataFrame([("Chief Clerk search slip, exact spelling " * 4,), ("Office Memorandum. On June 5, 1957 an unidentified object was sighted. " * 5,), ("The newspaper magazine of that day printed a long story about it. " * 4,), ("tiny",), (None,)], "b string")
    cues = {"routing": "(?i)search slip|exact spelling|chief clerk", "memo": "(?i)memorandum", "observation": "(?i)unidentified|sighted", "press": "(?i)newspaper|magazine", "date": "(?i)june", "place": "(?i)ridge"}
    assert [r.route for r in D.page_signals(df, "b", cues).collect()] == ["skip_routing", "narrative", "skip_press", "skip_empty", "skip_empty"]


def test_classifier_takes_the_first_rule(spark):
    df = spark.createDataFrame([("contract and report",), ("report",), (None,)], "t string")
    got = [(r.document_class, r.confidence) for r in D.classify(df, "t", [("contract", "high", r"contract"), ("incident", "medium", r"report")]).collect()]
    assert got == [("contract", "high"), ("incident", "medium"), ("other", "low")]


# --- evidence ---------------------------------------------------------------------------------------------------------


def test_quote_gate(spark):
    src = "on the evening of may fifth the crew reported a bright red light moving slowly over the harbour before it turned north and was lost in cloud " * 5
    quotes = [("the crew reported a bright red light moving slowly", "t", "ok"), ("before it turned north crew a bright red light and was lost", "t", "ok"), ("invented words that nobody in that file ever wrote down", "t", "absent"), ("too short", "t", "short"), ("the crew reported a bright red light", "", "incomplete"), (None, "t", "short")]
    df = spark.createDataFrame([(q, t, src, w) for q, t, w in quotes], "q string, title string, s string, want string").withColumn("f", F.lower("q"))
    assert all(r.gate == r.want for r in E.quote_gate(df, "q", "f", "s", ["title"]).collect())


def test_sufficiency(spark):
    long = "The witness observed a bright light hovering over the lake for nearly ten minutes that night in June."
    cases = [(long, "x", "ok"), ("Too short.", "x", "excerpt_too_short_for_claim"), ("a" * 90, "x", "excerpt_too_few_words"), ("word " * 20, "x", "excerpt_lacks_observation_language"), (None, None, "excerpt_too_short_for_claim")]
    df = spark.createDataFrame(cases, "e string, t string, want string")
    assert all(r.got == r.want for r in df.select("want", E.sufficiency("e", "t").alias("got")).collect())


# --- linking and retrieval --------------------------------------------------------------------------------------------


def test_candidates_and_controls(spark, rows):
    p = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x"), (None, "y")], "a string, b string")
    assert rows(L.candidates({"k": p})) == [("k", "x", "y")]
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(30)], "i string")
    got = rows(L.controls(df, "i", F.lit(True)))
    assert len(got) == 20 and got[0] == ("00", "01") and got[-1] == ("00", "20")


def test_nearest_and_inverted_lists(spark):
    r = random.Random(7)
    vs = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(400)] + [(400, [0.0] * 16), (401, None)]
    df = spark.createDataFrame(vs, "id int, v array<double>").filter("v is not null")
    q = df.filter("id % 20 = 0")
    exact = {(x.id, x.other) for x in Q.nearest(q, df, "id", "v", 5, exclude_self=True).collect()}
    near = {(x.id, x.other) for x in Q.inverted_lists(q, df, "id", "v", 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert not any(400 in p for p in exact)


def test_questions_become_plans():
    p = plan_question("What are the oldest cases of the 1950s?")
    assert (p.kind, p.newest_first, p.filters[0]) == ("extreme", False, ("occurred_at", "gte", "1950-01-01"))
    assert plan_question("unresolved cases in 1966").kind == "unresolved" and plan_question("light near harbour").topic == "harbour"


# --- sources and sinks ------------------------------------------------------------------------------------------------


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text('﻿Release Date,Title,Type,Description Blurb,DVIDS Video ID,Agency,PDF | Image Link\n5/8/26,"DOW-UAP-D001, a file",PDF ,"say ""hi"",\nnext",,Department of War,https://x.example/a.pdf\n,Clip,AUD,,123,FBI,\n9/18/26,Odd,???,,,,\n', encoding="utf-8")
    r = {x.title: x for x in manifest.manifest_records(manifest.resolve_headers(manifest.read_csv(spark, str(f))), "p", {"5/8/26": 1, "9/18/26": 6}).collect()}
    assert r["DOW-UAP-D001, a file"].identity_key == "p:DOW-UAP-D001" and r["DOW-UAP-D001, a file"].release_number == 1 and r["DOW-UAP-D001, a file"].description == 'say "hi", next' and r["DOW-UAP-D001, a file"].agency == "DoW"
    assert r["Clip"].source_type == "audio" and r["Clip"].metadata == {"video_id": "123"} and r["Clip"].identity_key.startswith("p:h:") and r["Odd"].source_type == "other"
    with pytest.raises(FileNotFoundError):
        manifest.first_readable(spark, [str(tmp_path / "none")])


def test_snapshots_and_upserts(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    one_, two = sinks.snapshot(df, str(tmp_path / "s"), "2026-01-01").first(), sinks.snapshot(df.repartition(3), str(tmp_path / "s"), "2026-01-02").first()
    assert one_["digest"] == two["digest"] and one_["rows"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.snapshot(df, str(tmp_path / "s"), "2026-01-01").first()
    p = str(tmp_path / "u")
    sinks.upsert(spark, p, df, ["k"])
    fresh = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    assert rows(sinks.upsert(spark, p, fresh, ["k"])) == rows(sinks.upsert(spark, p, fresh, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]


def test_front_matter(spark):
    df = spark.createDataFrame([("n-7", "---\npage: 12\nkind: a: b\n---\nbody\ntext"), ("n-8", "no marks"), ("n", None)], "name string, t string")
    got = {r.name: (r.page, r.body) for r in manifest.front_matter(df, "t", "name").collect()}
    assert got == {"n-7": (12, "body\ntext"), "n-8": (8, "no marks"), "n": (None, "")}


def test_token_pairs_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("red blue pale dark disc cone ring oval light wing".split(), k=r.randrange(1, 6)))) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("shared", F.lit("clash"))
    got = {tuple(x) for x in M.token_pairs(df, df, "id", "t", 2).filter("a < b").collect()}
    sets = {i: set((t or "").split()) for i, t in rows}
    assert got == {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 2}


def joined_rows(df):
    """Rows that the joins of a collected DataFrame gave."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_short_words_of_undated_events_make_no_pairs_on_the_way(spark, rows):
    labels = ["Lake Meridian / 1952", "Meridian Hill / 1952", "UNDT Meridian", "UNDT Observatory", "Observatory UNDT", "Hill UNDT / 1960", *(f"UNDT {n}" for n in range(300))]
    k = [(f"{i:03d}", (re.search(r"(?:19|20)\d\d", x) or [""])[0], t) for i, x in enumerate(labels) for t in set(re.findall(r"\b[A-Z][a-zA-Z]{3,}\b", x))]
    want = {(i, j) for i, y, t in k for j, z, u in k if i < j and t == u and (y == z or not y or not z) and (y or z or len(t) >= 8)}
    got = M.same_event_pairs(spark.createDataFrame(k, "id string, y string, t string"))
    assert rows(got) == sorted(want) and len(want) > 300
    found = got.collect()
    assert len(found) == len(want) and joined_rows(got) < 2 * len(want)
