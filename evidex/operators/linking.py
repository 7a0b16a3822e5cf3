"""From fragments to events and series: candidates, events, decisions and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.operators.relational import episodes


def candidates(frames: dict[str, DataFrame]) -> DataFrame:
    """(kind, a, b): undirected pairs of several generators (columns a and b), each once a kind, without loops."""
    out = [f.select(F.lit(k).alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for k, f in frames.items()]
    return reduce(DataFrame.unionByName, out).filter("a is not null and b is not null and a <> b").distinct()


def events(fragments: DataFrame, source: str, order: list[str], member: str, place: str, day: str, starts: Column) -> DataFrame:
    """One event for each episode of a source: (source, episode, label, members in order, n, first day).

    starts: where a fragment starts a new episode. The label is place / year / source#epN of the first fragment that has each.
    """
    e = episodes(fragments, [source], order, starts)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(member).alias("__m"), F.col(place).alias("__p"), F.col(day).alias("__d"))))
    g = e.groupBy(source, "episode").agg(items.alias("__i"))
    first = lambda f: F.try_element_at(F.filter(F.transform("__i", lambda x: x[f]), lambda x: x.isNotNull()), F.lit(1))
    label = F.concat_ws(" / ", F.coalesce(first("__p"), F.lit("unknown place")), F.coalesce(F.date_format(first("__d"), "yyyy"), F.lit("undated")), F.concat(F.col(source), F.lit("#ep"), F.col("episode").cast("string")))
    return g.select(source, "episode", label.alias("label"), F.array_join(F.transform("__i", lambda x: x["__m"]), "|").alias("members"), F.size("__i").cast("long").alias("n"), first("__d").alias("first_day"))


def star(members: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b): every item of a key tied to the key's smallest item, which ties all of them without forming pairs within a key."""
    m = members.select(F.col(key).alias("k"), F.col(item).alias("b")).filter("k is not null and b is not null").distinct()
    return m.join(m.groupBy("k").agg(F.min("b").alias("a")), "k").filter("a <> b").select("a", "b")


def apply_rules(candidates_: DataFrame, files: DataFrame, members: DataFrame, case_events: DataFrame, series: dict[str, str]) -> DataFrame:
    """(relationship, status, left, right, band): what the candidates decide, each decision once.

    candidates_: kind, left, right, band and label. files: file, document_class, action. members: event_id, file. case_events: case_id,
    event_id. series: a regular expression over labels to the id of the series that they name.

    * catalog_pairing: the media file of a pair whose other file is extracted is media_for_event of every event of that file;
    * analysis_place: the file is analysis_of_event of the case's event, auto_supported where the band is strong, else needs_review;
    * series_identifier: the file is of the same_series as the series named by its label (or the id itself where `right` is one);
      other labels decide nothing; a series never makes one event of several;
    * place_overlap: same_event for review, where the two cases lie in different events.
    """
    row = lambda df, rel, status, left, right, band: df.select(F.lit(rel).alias("relationship"), status.alias("status"), F.col(left).alias("left"), F.col(right).alias("right"), band.alias("band"))
    auto, strong = F.lit("auto_supported"), F.lit("strong")
    of = lambda x: files.select(F.col("file").alias(x), F.col("document_class").alias(f"class_{x}"), F.col("action").alias(f"action_{x}"))
    p = candidates_.filter("kind = 'catalog_pairing'").join(of("left"), "left", "left").join(of("right"), "right", "left")
    first = (F.col("class_left") == "media_metadata") & (F.col("action_right") == "extract")
    second = (F.col("class_right") == "media_metadata") & (F.col("action_left") == "extract")
    p = p.select(F.when(first, F.col("left")).when(second, F.col("right")).alias("media"), F.when(first, F.col("right")).when(second, F.col("left")).alias("file")).filter("media is not null")
    media = row(p.join(members.select("event_id", "file").distinct(), "file"), "media_for_event", auto, "media", "event_id", strong)
    e = case_events.select(F.col("case_id").alias("right"), "event_id").distinct()
    a = candidates_.filter("kind = 'analysis_place'").join(e, "right")
    analysis = row(a, "analysis_of_event", F.when(F.col("band") == "strong", "auto_supported").otherwise("needs_review"), "left", "event_id", F.coalesce("band", F.lit("medium")))
    known = F.when(F.col("right").isin(*series.values()), F.col("right"))
    for pattern, id_ in series.items():
        known = F.coalesce(known, F.when(F.col("label").rlike(pattern), F.lit(id_)))
    s = candidates_.filter("kind = 'series_identifier'").withColumn("series", known).filter("series is not null")
    same_series = row(s, "same_series", auto, "left", "series", strong)
    o = candidates_.filter("kind = 'place_overlap'").join(e.withColumnRenamed("event_id", "event_b"), "right")
    o = o.join(case_events.select(F.col("case_id").alias("left"), F.col("event_id").alias("event_a")).distinct(), "left").filter("event_a <> event_b")
    overlap = row(o, "same_event", F.lit("review_supported"), "event_a", "event_b", F.lit("medium"))
    return reduce(DataFrame.unionByName, (media, analysis, same_series, overlap)).distinct()


def controls(df: DataFrame, id_: str, generic: Column, most: int = 20) -> DataFrame:
    """(a, b): the first pairs in id order of rows whose places are generic: what must never be merged, as a sample to check.

    The smallest ids that such pairs can hold suffice: the k-th pair in order lies among the first k + 1 rows.
    """
    g = df.filter(generic).select(F.col(id_).alias("a")).distinct().orderBy("a").limit(most + 1)
    return g.join(F.broadcast(g.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).orderBy("a", "b").limit(most)  # most + 1 rows


def ordered_distinct(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, position, value): the values of each key, each once, by where it first stands."""
    first = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("__o"))
    return first.select(key, F.row_number().over(W.partitionBy(key).orderBy("__o", value)).alias("position"), value)
