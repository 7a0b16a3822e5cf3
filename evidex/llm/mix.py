"""Mixing sources to target weights in tokens: entropy balancing with a cap on repeats.

Each document gets a rate: the rates nearest to one copy each, in relative entropy, whose token sums are what the targets
ask. They are exponentially tilted by the document's length; Newton iterations on the dual, one number a source, are
aggregations over all documents. Rates are then rounded into whole copies along the documents' lengths.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.session import drop_scratch, fixed_rows, scratch_dir, written

#: Where the public tokenizers' files lie; a parameter of count_tokens().
TOKENIZERS = os.environ.get("EVIDEX_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """df with the number of tokens of a text column under a public byte-level vocabulary; null for a null text, 0 for an empty one."""

    @F.pandas_udf("long")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in it:
            yield pd.Series([None if not isinstance(t, str) else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return df.withColumn(out, count(F.col(text)))


def _rate(cap: str, tilt: str, size: str) -> Column:
    """The rate of a document: exponentially tilted by its size, at most the cap."""
    return F.least(F.col(cap).cast("double"), F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(tilt) * F.col(size)))))


def solve_tilts(sized: DataFrame, goals: dict[str, dict], rounds: int = 40, tolerance: float = 1e-5) -> dict[str, float]:
    """The tilt of each source for which its documents' rates times sizes (relative to the source's mean) sum to its goal.

    goals: source -> {goal, cap, mean}. Each round is one aggregation over all documents (columns source, tokens) that gives
    the sum and its derivative a source; the step is Newton's, held within the bracket found so far.
    """
    spark = sized.sparkSession
    tilt = {s: 0.0 for s in goals}
    low, high = {s: -60.0 for s in goals}, {s: 60.0 for s in goals}
    open_ = set(goals)
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(s, float(goals[s]["cap"]), float(goals[s]["mean"]), tilt[s]) for s in sorted(open_)], "source string, cap double, mean double, tilt double")
        d = sized.join(F.broadcast(now), "source").withColumn("x", F.col("tokens") / F.col("mean"))  # now: one row a source of the fixed list of targets
        r = _rate("cap", "tilt", "x")
        sums = d.groupBy("source").agg(F.sum(r * F.col("x")).alias("f"), F.sum(F.when(r < F.col("cap"), r * F.col("x") * F.col("x")).otherwise(0.0)).alias("df")).collect()
        for row in sums:
            s, goal = row["source"], goals[row["source"]]["goal"]
            gap = row["f"] - goal
            if abs(gap) <= tolerance * max(goal, 1e-9):
                open_.discard(s)
                continue
            low[s], high[s] = (tilt[s], high[s]) if gap < 0 else (low[s], tilt[s])
            step = tilt[s] - gap / row["df"] if row["df"] > 0 else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-9:
                open_.discard(s)
    return tilt


def mix(docs: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total: int | None = None, seed: int = 0, bucket: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(copies, report). copies: (key, source, tokens, rate, copies) of the documents with at least one copy; report: a row a target.

    targets: (source, target_share, max_repeats), a short fixed list; shares are brought to a sum of 1. total: the size of the
    mixture in tokens, by default that of all documents of the sources with a target. A source that even at its cap holds
    less than its share of total is taken at its cap, and the report says what is short. report: source, target_share,
    max_repeats, documents, tokens_available, tokens_target, tokens_reached, share_reached (of what came out),
    shortfall_tokens. Defined results: documents without a source, key or tokens, with 0 tokens, or of a source without a
    target are left out; a target without documents is short of all; a null or negative cap or share is 0; repeated
    rows are documents of their own; no documents or targets give empty copies.
    Rounding runs along the documents by length, in buckets of about bucket documents by hash, so that no source is ordered
    as a whole.
    """
    spark = docs.sparkSession
    root = scratch_dir(spark)
    aims = [(r[0], max(float(r[1] or 0), 0.0), max(int(r[2] or 0), 0)) for r in fixed_rows(targets.select("source", "target_share", "max_repeats").filter("source is not null"), 10_000)]
    whole = sum(a[1] for a in aims) or 1.0
    t = spark.createDataFrame([(s, x / whole, c) for s, x, c in aims], "source string, target_share double, max_repeats int")
    src = docs.select(F.col(key).alias("key"), F.trim(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("tokens")).filter("key is not null and tokens > 0")
    sized = written(src.join(F.broadcast(t.select("source")), "source"), f"{root}/sized")  # the fixed list of targets
    have = {r["source"]: r for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    size = total if total is not None else sum(r["t"] for r in have.values())
    goals, fixed = {}, {}
    for s, share, cap in aims:
        if s not in have:
            continue
        want, most = share / whole * size, cap * have[s]["t"]
        if want >= most or want <= 0:
            fixed[s] = float(cap) if want > 0 else 0.0
        else:
            mean = have[s]["t"] / have[s]["n"]
            goals[s] = {"goal": want / mean, "cap": cap, "mean": mean}
    tilts = solve_tilts(sized, goals)
    plan = [(s, float(c), have[s]["t"] / have[s]["n"], tilts.get(s, 0.0), fixed.get(s), -(-have[s]["n"] // bucket)) for s, _, c in aims if s in have]
    p = spark.createDataFrame(plan, "source string, cap double, mean double, tilt double, fixed double, buckets long")
    d = sized.join(F.broadcast(p), "source").withColumn("x", F.col("tokens") / F.col("mean"))  # the fixed list of targets
    d = d.withColumn("rate", F.coalesce("fixed", _rate("cap", "tilt", "x"))).withColumn("h", F.xxhash64("key", F.lit(seed)))
    d = d.withColumn("b", F.pmod("h", "buckets"))
    along = W.partitionBy("source", "b").orderBy("tokens", "h", "key").rowsBetween(W.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "b", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    upto = F.sum("rate").over(along)
    d = d.withColumn("copies", (F.floor(upto + start + 1e-9) - F.floor(upto - F.col("rate") + start + 1e-9)).cast("int"))
    copies = written(d.select("key", "source", "tokens", F.round("rate", 6).alias("rate"), F.least("copies", F.col("cap").cast("int")).alias("copies")), f"{root}/copies")
    drop_scratch(spark, f"{root}/sized")
    got = copies.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_reached"))
    report = t.join(got, "source", "left").fillna(0, ["documents", "tokens_available", "tokens_reached"])
    out = report.agg(F.sum("tokens_reached").alias("__all"))
    report = report.crossJoin(F.broadcast(out))  # one row
    report = report.select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats", "documents", "tokens_available", F.round(F.col("target_share") * size).cast("long").alias("tokens_target"), "tokens_reached",
        F.round(F.try_divide("tokens_reached", "__all"), 6).alias("share_reached"), F.greatest(F.lit(0), F.round(F.col("target_share") * size).cast("long") - F.col("tokens_reached")).alias("shortfall_tokens"),
    )
    return copies.filter("copies > 0").withColumnRenamed("key", key), report
