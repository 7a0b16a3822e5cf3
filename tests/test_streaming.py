"""Streams equal their batch counterparts on closed windows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidex.streaming import windows as S


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(i, at + timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.tumbling(S.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, kind string"), "ts", ["kind"], "1 hour", "10 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("hours").collect()}
    batch = {tuple(r) for r in S.tumbling(df, "ts", ["kind"], "1 hour", "10 minutes").collect()}
    last = max(r[0] for r in batch)
    assert got and got <= batch and {r for r in batch if r[0] < last - timedelta(hours=1)} <= got


def test_sessions_and_duplicates_in_batch(spark):
    at = datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, at, "u"), (2, at + timedelta(minutes=5), "u"), (3, at + timedelta(hours=2), "u")], "event_id long, ts timestamp, user string")
    assert sorted(r.n for r in S.sessions(df, "ts", "user", "30 minutes", "1 hour").collect()) == [1, 2]
    assert df.select(F.count("*")).first()[0] == 3
