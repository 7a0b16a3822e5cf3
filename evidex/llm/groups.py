"""Consolidating pairwise ties into groups: connected components by seed-tree pruning.

Every round, each vertex tells its neighbours and itself the smallest id of its neighbourhood (min selection). A vertex that
is told no id of its own is nobody's minimum: it drops out of the graph and is hung below the least id it was told in the
propagation forest, and the other ids it was told are tied to that least one (pruning). When no edge is left, the vertices
that never dropped out are the seeds, and their ids flow down the forest, latest round first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import drop_scratch, keep_only, scratch_dir, written


def clean_id(c: Column | str) -> Column:
    """An id without blanks around it, in upper case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(t) > 0, t)


def star_edges(members: DataFrame, hub: str, item: str) -> DataFrame:
    """Edges (u, v), u < v, from the smallest item of every hub to its other items: a hub of n items gives n - 1 edges.

    The minimum is an aggregate with partial sums, and the join back to it is split by adaptive execution where one hub
    holds much of the table, so no hub is ever gathered in one task.
    """
    m = members.select(F.col(hub).alias("__h"), F.col(item).alias("v")).filter("__h is not null and v is not null").distinct()
    least = m.groupBy("__h").agg(F.min("v").alias("u"))
    return m.join(least, "__h").filter("u < v").select("u", "v").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (columns u and v, strings or numbers) and of nodes (column node).

    component is the smallest node of the group in plain order. Defined results: edges with a null end and nulls in
    nodes are ignored; loops, repeated and reversed edges change nothing; a node without an edge is its own group; empty
    input gives an empty table; other columns are ignored. Every round is a written table, so a lost executor costs at
    most a round. Each round is a fixed number of aggregations with partial minima and joins that adaptive execution
    splits; nothing is collected but one count a round.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark)
    e = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    graph = written(both.distinct(), f"{root}/g0")
    forest: list[DataFrame] = []
    k = 0
    while not graph.isEmpty():
        if k >= max_rounds:
            raise RuntimeError(f"not converged after {max_rounds} rounds")
        # min selection: every vertex tells its neighbours and itself the least id around it
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = graph.join(least, "u").select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m")).distinct()
        told = written(told, f"{root}/h{k}")
        best = told.groupBy("u").agg(F.min("m").alias("best"), F.max((F.col("m") == F.col("u")).cast("int")).alias("own"))
        best = written(best, f"{root}/b{k}")
        # pruning: who was told no id of its own is no minimum of anyone and leaves the graph below its least candidate
        forest.append(best.filter("own = 0").select(F.col("u").alias("node"), F.col("best").alias("parent")))
        rest = told.join(best.select("u", "best"), "u").filter("m <> best").select(F.col("m").alias("u"), F.col("best").alias("v"))
        turned = rest.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        k += 1
        graph = written(turned.distinct(), f"{root}/g{k}")
        drop_scratch(spark, f"{root}/h{k - 1}")
        if k > 1:  # the first graph names all vertices
            drop_scratch(spark, f"{root}/g{k - 1}")
    # seeds: all nodes that never dropped out; their ids flow down, the last to drop first
    if forest:
        dropped = forest[0]
        for f in forest[1:]:
            dropped = dropped.unionByName(f)
        seeds = spark.read.schema(graph.schema).parquet(f"{root}/g0").select(F.col("u").alias("node")).distinct().join(dropped.select("node"), "node", "left_anti")
        label = written(seeds.select("node", F.col("node").alias("component")), f"{root}/l{k}")
        for i in range(len(forest) - 1, -1, -1):
            # each level is written once; a parent has its label in a level that dropped later, or is a seed
            down = forest[i].join(label.select(F.col("node").alias("parent"), "component"), "parent").select("node", "component")
            label = label.unionByName(written(down, f"{root}/l{i}"))
        keep_only(spark, root, *(f"l{i}" for i in range(k + 1)))
    else:
        label = graph.select(F.col("u").alias("node"), F.col("u").alias("component"))
    if nodes is None:
        return label
    n = nodes.select("node").filter("node is not null").distinct()
    return n.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
