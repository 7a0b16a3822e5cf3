"""Filters, ordered picks, unions, diffs and sinks as functions of DataFrames with parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.text import blank

#: Operators that a filter specification may name; nothing else is ever looked up.
OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "ilike": lambda c, v: c.ilike(v),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "contains_all": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
}


def where(df: DataFrame, spec: list[tuple[str, str, object]], any_of: bool = False) -> DataFrame:
    """df filtered by (column, operator, value) triples, all of them or any; an unknown operator is an error."""
    conditions = [OPERATORS[op](F.col(c), v) for c, op, v in spec]
    if not conditions:
        return df
    return df.filter(reduce(lambda a, b: a | b if any_of else a & b, conditions))


def facets(df: DataFrame, **wanted: object) -> DataFrame:
    """df filtered by equality with every given value; None and '' are left out."""
    return where(df, [(c, "eq", v) for c, v in wanted.items() if v not in (None, "")])


def text_search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the needle, whatever the letter case; a blank needle keeps all."""
    n = needle.strip().strip("\"'").lower()
    if not n:
        return df
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(n), F.lit(False)) for c in columns)))


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def precedence_union(frames: list[DataFrame], key: str, position: str) -> DataFrame:
    """Union of frames in which an earlier frame wins a key, within a frame the lowest position; blank keys are dropped."""
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).filter(~blank(key))
    return first_per(u, [key], ["__p", position]).drop("__p")


def prefer(df: DataFrame, key: str, preferred: Column, position: str, others: str | None = None) -> DataFrame:
    """One row for each key: a preferred one if there is any, else (and among those) the last by position; others: a column for the number of the rest.

    An aggregate with partial maxima: the rows of a key are never gathered.
    """
    order = F.struct(F.coalesce(preferred.cast("int"), F.lit(0)), F.col(position))
    won = df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("__w"), (F.count(F.lit(1)) - 1).alias("__n"))
    return won.select(key, "__w.*", *([F.col("__n").alias(others)] if others else []))


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): 'new', 'deprecated', 'modified' or 'unchanged' of two snapshots by their fields."""
    from evidex.functions.values import fingerprint

    a = old.select(key, fingerprint(fields).alias("__a"))
    b = new.select(key, fingerprint(fields).alias("__b"))
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "deprecated").when(F.col("__a") != F.col("__b"), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def returned(changes: DataFrame, old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """changes with keys that were deprecated and are active again as 'returned'."""
    s = old.select(key, F.col(status).alias("__a")).join(new.select(key, F.col(status).alias("__b")), key)
    back = s.filter("__a = 'deprecated' and __b = 'active'").select(key, F.lit(True).alias("__back"))
    return changes.join(back, key, "left").withColumn("change", F.when(F.col("__back"), "returned").otherwise(F.col("change"))).drop("__back")


def merge(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert: rows of fresh replace rows of base with the same keys; of repeated keys in fresh any equal row, else the first in column order."""
    one = first_per(fresh, keys, [c for c in fresh.columns if c not in keys] or keys)
    return base.join(one.select(*keys), keys, "left_anti").unionByName(one)


def insert_absent(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """base and the rows of fresh whose key it doesn't have."""
    return base.unionByName(fresh.join(base.select(key), key, "left_anti"))


def extend_collisions(df: DataFrame, code: str, source: str, order: str, digits: int = 4) -> DataFrame:
    """df whose repeated codes, all but the first in order, get that many more digits of the SHA-1 of a column."""
    n = F.row_number().over(W.partitionBy(code).orderBy(order))
    more = F.concat(F.col(code), F.upper(F.substring(F.sha1(F.coalesce(F.col(source), F.lit(""))), 7, digits)))
    return df.withColumn("__n", n).withColumn(code, F.when(F.col("__n") > 1, more).otherwise(F.col(code))).drop("__n")


def episodes(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """df with episode, counted from 1 in each key: a row starts a new one if starts holds for it (the first row always does)."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    s = F.when(first | F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return df.withColumn("__s", s).withColumn("episode", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def ring_offsets(df: DataFrame, keys: list[str], order: list[str], radius: float = 0.04, degrees: float = 60.0) -> DataFrame:
    """df with dx and dy: the k-th row of a key stands on a ring at k times an angle, the first in the middle."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    df = df.withColumn("k", k)
    on = lambda f: F.when(F.col("k") == 0, 0.0).otherwise(F.round(F.lit(radius) * f(F.radians(F.col("k") * F.lit(degrees))), 6))
    return df.withColumn("dx", on(F.cos)).withColumn("dy", on(F.sin))
