"""Vector, lexical and hybrid retrieval, and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import blank
from evidex.functions.values import dot, norm
from evidex.operators.relational import top_per


def unit(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): vectors of length one in double precision; vectors without length are dropped."""
    v = F.col(vector)
    n = norm(v)
    return df.select(F.col(id_), F.transform(v, lambda x: x.cast("double") / n).alias("v"), n.alias("__n")).filter("__n > 0").drop("__n")


def nearest(queries: DataFrame, items: DataFrame, id_: str, vector: str, k: int, least: float = -2.0, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """(id, other, similarity, rank): the k most similar items for each query above a threshold; ties go to the smaller id.

    Both sides are brought to length one once, so a pair costs one product. The queries are a stated set searched against
    all items in one pass; pairs are cut to k per query in each partition before they are shuffled.
    """
    q = unit(queries, id_, vector).withColumnRenamed("v", "q")
    i = unit(items, id_, vector).withColumnRenamed(id_, "other")
    pairs = i.crossJoin(q).select(id_, "other", F.round(dot(F.col("q"), F.col("v")), digits).alias("similarity"))
    pairs = pairs.filter(F.col("similarity") > least)
    if exclude_self:
        pairs = pairs.filter(F.col("other") != F.col(id_))
    return top_per(pairs, [id_], [F.desc("similarity"), "other"], k)


def token_score(tokens: Column, fields: list[tuple[Column, float]], long: int = 4) -> Column:
    """Sum over tokens of the weights of the fields that hold them; tokens longer than `long` count twice."""

    def one(x: Column) -> Column:
        hits = F.lit(0.0)
        for text, weight in fields:
            hits = hits + F.when(F.lower(F.coalesce(text, F.lit(""))).contains(x), float(weight)).otherwise(0.0)
        return hits * F.when(F.length(x) > long, 2.0).otherwise(1.0)

    return F.aggregate(tokens, F.lit(0.0), lambda s, x: s + one(x))


def reciprocal_rank(hits: DataFrame, query: str, rank: str, right: Column, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query, first, rr, recall_at_k ...): rank of the first right hit of each query, its reciprocal (0 without), and whether it is in the first k."""
    first = hits.groupBy(query).agg(F.min(F.when(right, F.col(rank))).alias("first"))
    return first.select(query, "first", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), *(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"recall_at_{k}") for k in cuts))


def hybrid(lexical: DataFrame, vector: DataFrame, query: str, id_: str, k: int, weight: float = 20.0) -> DataFrame:
    """(query, id, score, rank): the best of a lexical score and a weighted similarity for each id, first k a query."""
    u = lexical.select(query, id_, F.col("score").cast("double").alias("score")).unionByName(vector.select(query, id_, (F.col("similarity") * weight).alias("score")))
    best = u.filter(~blank(F.col(id_).cast("string"))).groupBy(query, id_).agg(F.round(F.max("score"), 6).alias("score"))
    return top_per(best, [query], [F.desc("score"), id_], k)


def longest_phrase(tokens: Column) -> Column:
    """The longest token, of equal lengths the first in the alphabet; null for none."""
    ranked = F.array_sort(F.transform(tokens, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t"))))
    return F.try_element_at(ranked, F.lit(1))["t"]


def citation_check(answers: DataFrame, id_: str, cited: str, allowed: DataFrame, key: str, status: str) -> DataFrame:
    """(id, citation, verdict): each cited key as 'unknown', 'excluded', 'source_only' or 'valid' by the status of the allowed set."""
    c = answers.select(id_, F.explode(cited).alias("citation"))
    s = allowed.select(F.col(key).alias("citation"), F.col(status).alias("__s")).dropDuplicates(["citation"])
    verdict = F.when(F.col("__s").isNull(), "unknown").when(F.col("__s") == "excluded", "excluded").when(F.col("__s") == "source_only", "source_only").otherwise("valid")
    return c.join(s, "citation", "left").select(id_, "citation", verdict.alias("verdict"))


def inverted_lists(queries: DataFrame, items: DataFrame, id_: str, vector: str, k: int, lists: int = 16, probes: int = 10, sample: int = 2000) -> DataFrame:
    """(id, other, similarity, rank): approximate nearest items: every item lies in the list of its nearest centre, and only
    the lists of the `probes` nearest centres of a query are searched.

    The centres are vectors of a sample of at most `sample` rows (the smallest hashes of the ids), spread by taking the one
    farthest from those taken so far; every row is indexed.
    """
    spark = items.sparkSession
    u = unit(items, id_, vector)
    rows = [r["v"] for r in u.orderBy(F.xxhash64(id_)).limit(sample).collect()]  # a bounded sample, by parameter
    centres = rows[:1]
    best = [sum(a * b for a, b in zip(r, centres[0], strict=True)) for r in rows] if rows else []
    while rows and len(centres) < min(lists, len(rows)):
        c = rows[min(range(len(rows)), key=best.__getitem__)]
        centres.append(c)
        best = [max(x, sum(a * b for a, b in zip(r, c, strict=True))) for x, r in zip(best, rows, strict=True)]
    c = spark.createDataFrame([(i, v) for i, v in enumerate(centres)], "list int, c array<double>")
    near = u.crossJoin(F.broadcast(c)).select(id_, "list", dot(F.col("v"), F.col("c")).alias("s"))  # at most `lists` rows
    home = near.groupBy(id_).agg(F.max_by("list", F.struct("s", -F.col("list"))).alias("list")).join(u, id_).select(F.col(id_).alias("other"), "list", "v")
    qs = unit(queries, id_, vector).withColumnRenamed("v", "q")
    probe = top_per(near.join(qs.select(id_), id_, "left_semi"), [id_], [F.desc("s"), "list"], probes).select(id_, "list").join(qs, id_)
    hits = home.join(probe, "list").filter(F.col("other") != F.col(id_)).select(id_, "other", F.round(dot(F.col("q"), F.col("v")), 6).alias("similarity"))
    return top_per(hits, [id_], [F.desc("similarity"), "other"], k)
