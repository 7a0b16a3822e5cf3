"""Streams over the event log: the batch operators' counterparts with watermarks. An extension; the archive itself has no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, time: str = "ts") -> DataFrame:
    """Parquet files of a folder as a stream; the time column as a timestamp in the session's zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and keys; events later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: a gap without events ends one."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, time: str, id_: str, late: str) -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([id_])
