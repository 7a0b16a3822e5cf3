"""p3: groups against brute force on random graphs, chains, hubs, and edge cases."""

import random

import pytest

from evidex.llm import groups as G


def brute(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("kind", "seed"), [("random", 1), ("random", 2), ("chain", 3), ("hub", 4), ("sparse", 5)])
def test_against_brute_force(spark, kind, seed):
    r = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    r.shuffle(names)
    if kind == "chain":
        edges = list(zip(names, names[1:], strict=False))
    elif kind == "hub":
        edges = [(names[0], n) for n in names[1:80]] + [(names[80], n) for n in names[81:]]
    else:
        edges = [(r.choice(names), r.choice(names)) for _ in range(110 if kind == "random" else 40)]
    df = spark.createDataFrame([*edges, *edges[:5], *((v, u) for u, v in edges[:5]), (None, names[0]), (names[1], None)], "u string, v string").selectExpr("*", "1 as component")
    nodes = spark.createDataFrame([(n,) for n in names] + [(None,)], "node string")
    got = {x.node: x.component for x in G.connected_components(df, nodes).collect()}
    assert got == brute(names, [(u, v) for u, v in edges])


def test_numbers_and_empty(spark):
    e = spark.createDataFrame([(3, 2), (2, 10), (7, 7)], "u long, v long")
    assert {(r.node, r.component) for r in G.connected_components(e).collect()} == {(2, 2), (3, 2), (10, 2)}
    assert G.connected_components(e.limit(0)).count() == 0
    n = spark.createDataFrame([(1,), (1,)], "node long")
    assert [tuple(r) for r in G.connected_components(e.limit(0), n).collect()] == [(1, 1)]


def test_ids_and_stars(spark):
    df = spark.createDataFrame([("e", " ab "), ("e", "AB"), ("e", "c"), ("f", None), (None, "x"), ("g", "\t"), ("g", "d")], "h string, c string")
    m = df.select("h", G.clean_id("c").alias("c"))
    assert sorted(tuple(r) for r in G.star_edges(m, "h", "c").collect()) == [("AB", "C")]
