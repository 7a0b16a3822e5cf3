"""p4: parsing, pair scores, cosine join and linkage against brute force, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidex.llm import names as N


@pytest.mark.parametrize(("name", "form"), [
    ("Constance D. Satrotoux", "satrotoux|constance|d|"), ("Satrotoux, C.D.", "satrotoux|c|d|"), ("SATROTOUX CONSTANCE D", "satrotoux|constance|d|"), ("Capt. Constance Satrotoux", "satrotoux|constance||capt"),
    ("Constance E Brotnixez, Captain", "brotnixez|constance|e|captain"), ("Satrotoux, Lt. Col. Connie", "satrotoux|connie||lt col"), ("Döxbivez, J.F.", "doxbivez|j|f|"), ("Patricia Drudkryxs0n", "drudkryxson|patricia||"), ("", "|||"),
])
def test_persons(name, form):
    assert N.parse_form("person", name) == form


@pytest.mark.parametrize(("kind", "a", "b", "same"), [
    ("person", "Kate Datskudini", "Katherine M. Datskudini", True), ("person", "Hank Datskudini", "H. N. Datskudini", True), ("person", "Henry N. Datskudini", "Henry M. Datskudini", False), ("person", "Henry Datskudini", "Daniel Datskudini", False),
    ("person", "LT Druddudski, Rob.", "Lt R. Druddudski", True), ("person", "Anthony Datskkudini", "Anthony L. Datskudini", True), ("unit", "2620 FG", "2620th Fighter Group", True), ("unit", "497 WG", "the 497th Weather Gp.", True),
    ("unit", "2954 RD", "Detachment, 2954th Radar", True), ("unit", "2620th Fighter Group", "2621st Fighter Group", False), ("unit", "328th Logistics Regiment", "3284th Survey Regiment", False), ("location", "Mt. Tovsexford", "Tovsexford, Mount", True),
    ("location", "Fort Tovsexford", "Mount Tovsexford", False), ("location", "Pt Brörkremfield", "Point Brorkremfield", True), ("program", "Noblegranite", "Granite, Noble (project)", True), ("program", "Project Umber Sickle", "Op. Umber Compass", False),
])
def test_pair_scores(kind, a, b, same):
    assert (N.pair_score(kind, N.parse_form(kind, a), N.parse_form(kind, b)) >= 0.62) == same


def test_average_linkage_against_brute_force():
    r = random.Random(1)
    for _ in range(30):
        n = 9
        sim = {(i, j): round(r.random(), 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.6}
        groups = [{i} for i in range(n)]
        while True:
            best = max(((sum(sim.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b)), -min(min(a), min(b)), -max(min(a), min(b)), a, b) for i, a in enumerate(groups) for b in groups[:i]), key=lambda t: t[:3], default=(0,))
            if best[0] < 0.5:
                break
            groups = [g for g in groups if g is not best[3] and g is not best[4]] + [best[3] | best[4]]
        got = N.average_linkage([(i, j, s) for (i, j), s in sim.items()] + [(i, i, 1.0) for i in range(n)], 0.5)
        assert {frozenset(k for k in range(n) if got[k] == v) for v in set(got.values())} == {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_by_rounds_equals_one_task(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{i:02d}", f"n{j:02d}", round(r.random(), 6)) for i in range(24) for j in range(i + 1, 24) if r.random() < 0.5]
    df = spark.createDataFrame([("x", *e) for e in edges], "component string, a string, b string, s double")
    one, many = ({q.fid: q.g for q in N.linked_groups(df, 0.55, most).collect()} for most in (10_000, 5))
    assert one == many and 1 < len(set(one.values())) < 24
    assert N.linked_groups(df.limit(0), 0.55).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_cosine_join_against_brute_force(spark):
    r = random.Random(2)
    keys = sorted({"".join(r.choices("abcde", k=r.randrange(4, 9))) for _ in range(120)})
    df = spark.createDataFrame([("location", k, N.grams("location", k)) for k in keys], "kind string, key string, grams array<string>")
    got = {(x.a, x.b) for x in N.similar_keys(df, 0.4).collect()}
    cut = {k: set(N.grams("location", k)) for k in keys}
    count = {g: sum(g in c for c in cut.values()) for c in cut.values() for g in c}
    w = {k: {g: math.log1p(len(keys) / count[g]) for g in c} for k, c in cut.items()}

    def cos(a, b):
        return sum(w[a][g] for g in w[a].keys() & w[b].keys()) / math.sqrt(sum(w[a].values()) * sum(w[b].values()))

    assert got == {(a, b) for a in keys for b in keys if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 4 and cos(a, b) >= 0.4}


def test_groups_and_edge_cases(spark):
    data = [("1", "person", "Henry N. Datskudini", "sentry"), ("2", "person", "Hank Datskudini", "sentry, 1950s"), ("3", "person", "DATSKUDINI HENRY N", "sentry"), ("4", "person", "Henry N. Datskudini", "pilot"), ("5", "person", None, None), ("6", None, "X", None),
            ("7", "unit", "12 FG", None), ("8", "unit", "12th Fighter Group", None), ("9", "unit", "!!", None), ("9", "unit", "!!", None), (None, "unit", "x", None)]
    df = spark.createDataFrame(data, "id string, kind string, name string, about string").withColumn("group", F.lit("clash")).withColumn("form", F.lit(1))
    g = N.name_groups(df, "id", "kind", "name", "about")
    got = {r.key: r.group for r in g.collect()}
    assert got["1"] == got["2"] == got["3"] == "1" and got["4"] == "4" and got["7"] == got["8"] and got["9"] == "9" and set(got) == {"1", "2", "3", "4", "7", "8", "9"}
    assert {(r.id_a, r.id_b) for r in N.pairs_of_groups(g).collect()} == {("1", "2"), ("1", "3"), ("2", "3"), ("7", "8")}
    assert N.name_groups(df.limit(0), "id", "kind", "name", "about").count() == 0


def test_near_keys_against_brute_force(spark):
    r = random.Random(3)
    keys = sorted({(k, "".join(r.choices("abc", k=r.randrange(1, 11)))) for k in ("person", "location", "program", "unit") for _ in range(150)})
    got = {tuple(x) for x in N.near_keys(spark.createDataFrame(keys, "kind string, key string")).collect()}
    assert got == {(k, a, b) for k, a in keys for j, b in keys if k == j != "unit" and a < b and N.osa(a, b, 2) <= N.allowed_edits(k, a, b)}


def test_two_typos_are_one_person_among_names_of_common_parts(spark):
    r = random.Random(4)
    common = [(f"c{i}", "person", f"Henry Me{''.join(r.choices('bcdfg', k=7))}ault") for i in range(40)]
    df = spark.createDataFrame([("1", "person", "Kate Metvexault"), ("2", "person", "Kate Mevtxeault"), *common], "id string, kind string, name string")
    got = {x.key: x.group for x in N.name_groups(df, "id", "kind", "name").collect()}
    assert got["2"] == "1"
