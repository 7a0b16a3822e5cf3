"""p9: token counts, shares, caps, rounding, and edge cases."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidex.llm import mix as X

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, s, r.randrange(20, 400)) for i, s in enumerate(r.choices(["web", "press", "small", "other"], [70, 20, 5, 5], k=3000))]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens int").withColumn("copies", F.lit(99)), rows


def test_shares_caps_and_shortfalls(spark):
    df, rows = docs(spark)
    t = spark.createDataFrame([("web", 0.4, 1), ("press", 0.35, 3), ("small", 0.2, 2), ("absent", 0.05, 4)], TARGETS)
    copies, report = X.mix(df, "doc_id", "source", "tokens", t)
    got = {r.source: r for r in report.collect()}
    have = {s: sum(k for _, x, k in rows if x == s) for s in ("web", "press", "small")}
    total = sum(have.values())
    assert got["absent"].tokens_reached == 0 and got["absent"].shortfall_tokens == round(0.05 * total)
    assert got["small"].tokens_reached == 2 * have["small"] and got["small"].shortfall_tokens > 0
    for s, share in (("web", 0.4), ("press", 0.35)):
        assert abs(got[s].tokens_reached / total - share) < 0.005
    for r in copies.collect():
        assert 1 <= r.copies <= {"web": 1, "press": 3, "small": 2}[r.source]
    assert copies.filter("source = 'other'").count() == 0
    reached = {r.source: r.t for r in copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert all(reached[s] == got[s].tokens_reached for s in reached)


def test_a_given_size_and_buckets(spark):
    df, _ = docs(spark, 2)
    t = spark.createDataFrame([("web", 0.5, 2), ("press", 0.5, 2)], TARGETS)
    _, report = X.mix(df, "doc_id", "source", "tokens", t, total=40_000, bucket=100)
    assert all(abs(r.tokens_reached - 20_000) < 800 and r.shortfall_tokens < 800 for r in report.collect())


def test_rates_solve_the_dual(spark):
    """Sums of the tilted rates hit the goals, with and without documents at the cap."""
    df, rows = docs(spark, 3)
    for source, factor, cap in (("web", 0.3, 1), ("press", 1.7, 2), ("small", 2.9, 3)):
        own = [k for _, s, k in rows if s == source]
        mean = sum(own) / len(own)
        goal = factor * len(own)
        tilt = X.solve_tilts(df.select("source", "tokens"), {source: {"goal": goal, "cap": cap, "mean": mean}})[source]
        import math

        assert sum(min(cap, math.exp(tilt * k / mean)) * k / mean for k in own) == pytest.approx(goal, rel=1e-4)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5), (None, "a", 5), (3, "a", None), (4, " a ", 0), (5, "b", 7)], "doc_id long, source string, tokens int")
    t = spark.createDataFrame([("a", 1.0, 3), (None, 0.5, 1), ("b", None, 2), ("c", 0.5, None)], TARGETS)
    copies, report = X.mix(df, "doc_id", "source", "tokens", t)
    assert {(r.doc_id, r.source) for r in copies.collect()} == {(1, "a")} and {r.source: r.documents for r in report.collect()} == {"a": 2, "b": 1, "c": 0}
    assert X.mix(df.limit(0), "doc_id", "source", "tokens", t)[0].count() == 0 and X.mix(df, "doc_id", "source", "tokens", t.limit(0))[0].count() == 0


@pytest.mark.skipif(not Path(X.TOKENIZERS, "byte_bpe_50k.tiktoken").exists(), reason="no tokenizer files")
def test_token_counts(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{X.TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    texts = ["The light moved.", "", "ünïcode — 東京 <|endoftext|>", "a\n\n  b", None]
    got = [r.tokens for r in X.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()]
    assert got == [None if t is None else len(tk.encode(t, add_special_tokens=False).ids) for t in texts]
