"""Streaming extension, as batch queries with the same results on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.plans.registry import Book
from evidex.streaming import windows as S

book = Book()
add = book.add


@add("ST-1", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1(t):
    return S.tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "10 minutes")


@add("ST-2", "SELECT user_id, min(ts::TIMESTAMP) AS start, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, e")
def st2(t):
    return S.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes", "10 minutes").select("user_id", "start", "n")
