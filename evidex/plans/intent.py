"""A question as a chain of filters, orders and limits: planned on the driver from the text, run as one DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.relational import text_search, where


@dataclass
class Intent:
    """What a question asks for; the first kind that applies, in this order: extreme, unresolved, decade, year, topic."""

    kind: str
    filters: list[tuple[str, str, object]] = field(default_factory=list)
    newest_first: bool | None = None
    topic: str = ""
    limit: int = 8


def plan_question(question: str) -> Intent:
    """The intent of a question: years and decades bound the date, oldest and newest give the order."""
    q = question.lower()
    bounds: list[tuple[str, str, object]] = []
    decade = re.search(r"\b((?:19|20)\d)0'?s\b", q) or re.search(r"(?<!\d)'?(\d)0'?s\b", q)
    year = re.search(r"\b((?:19|20)\d{2})\b(?!'?s)", q)
    if decade:
        first = int(decade[1]) * 10
        first += 0 if first >= 1900 else 1900 if first >= 20 else 2000
        bounds = [("occurred_at", "gte", f"{first}-01-01"), ("occurred_at", "lte", f"{first + 9}-12-31")]
    elif year:
        bounds = [("occurred_at", "gte", f"{year[1]}-01-01"), ("occurred_at", "lte", f"{year[1]}-12-31")]
    if re.search(r"\b(oldest|earliest|first)\b", q):
        return Intent("extreme", bounds, newest_first=False)
    if re.search(r"\b(newest|latest|most recent)\b", q):
        return Intent("extreme", bounds, newest_first=True)
    if "unresolved" in q or "unexplained" in q:
        return Intent("unresolved", [*bounds, ("resolution_status", "eq", "unresolved")])
    if bounds:
        return Intent("decade" if decade else "year", bounds)
    words = [w for w in re.findall(r"[a-z]{4,}", q) if w not in {"what", "which", "where", "were", "there", "have", "that", "this", "cases", "reports"}]
    return Intent("topic", topic=max(words, key=len, default=""))


def answer(cases: DataFrame, intent: Intent) -> DataFrame:
    """Unflagged cases for an intent, in a total order, at most its limit."""
    df = where(cases.filter("not flagged"), intent.filters)
    if intent.kind == "topic":
        df = text_search(df, intent.topic, ["title", "region"])
    if intent.kind == "extreme":
        df = df.filter("occurred_at is not null")
    order = F.col("occurred_at").desc_nulls_last() if intent.newest_first else F.col("occurred_at").asc_nulls_last()
    return df.orderBy(order, "case_id").limit(intent.limit)
