"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import groups, leak, matching, mix, names, quality, repair, spam, split
from evidex.session import fixed_rows, table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


# --- p3: groups of case ids -------------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every case id of event_members and canonical_events with the smallest case id it is tied to."""
    a = table(spark, d, "event_members").select("event_id", groups.clean_id("case_id").alias("case_id"))
    b = table(spark, d, "canonical_events").select("event_id", F.explode("member_case_ids").alias("c")).select("event_id", groups.clean_id("c").alias("case_id"))
    ties = a.unionByName(b).filter("case_id is not null").distinct()
    edges = groups.star_edges(ties, "event_id", "case_id")
    return groups.connected_components(edges, ties.select(F.col("case_id").alias("node"))).select(F.col("node").alias("case_id"), F.col("component").alias("group_id"))


# --- p5: pieces of oversized texts ------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lower(F.trim(F.regexp_replace("file_type", r"\s+", " ")))
    files = table(spark, d, "source_files").select("id", kind.alias("kind"), "ocr_text")
    limits = table(spark, d, "split_limits").select(F.col("file_type").alias("kind"), "max_chars", "overlap_chars")
    return split.split_texts(files.join(limits, "kind", "left"), "id", "ocr_text", "max_chars", "overlap_chars")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files whose text came out as more than one piece."""
    return _pieces(spark, d).filter("piece_no > 1").select("id").distinct()


@query
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all source files; copies of a file give its pieces once."""
    return _pieces(spark, d).select("id", "piece_no", "piece_from", "piece_to", "body_from", "cut", "piece").distinct()


ORACLE["p5_found"] = """
SELECT DISTINCT s.id FROM source_files s JOIN split_limits l ON l.file_type = lower(trim(s.file_type))
WHERE length(s.ocr_text) > l.max_chars
"""
ORACLE["p3_found"] = """
WITH RECURSIVE t AS (
  SELECT event_id, nullif(upper(trim(case_id)), '') AS c FROM event_members
  UNION SELECT event_id, nullif(upper(trim(m)), '') FROM (SELECT event_id, unnest(member_case_ids) AS m FROM canonical_events)),
ties AS (SELECT DISTINCT event_id, c FROM t WHERE c IS NOT NULL),
least_of AS (SELECT event_id, min(c) AS m FROM ties WHERE event_id IS NOT NULL GROUP BY event_id),
star AS (SELECT DISTINCT ties.c AS a, m AS b FROM ties JOIN least_of USING (event_id)),
e AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT c AS node, c AS other FROM ties UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT node AS case_id, min(other) AS group_id FROM reach GROUP BY node
"""


# --- p4: variant spellings of names -----------------------------------------------------------------------------------


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entity rows that name the same person, unit, program or place."""
    e = table(spark, d, "entities")
    return names.pairs_of_groups(names.name_groups(e, "id", "kind", "name", "description"))


# --- p10: keyword-stuffed and link-list pages -------------------------------------------------------------------------


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and verdict of every document."""
    return spam.flag_pages(spam.page_scores(table(spark, d, "documents"), "doc_id", "text"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of repeated keywords, links or tags."""
    return p10_scores(spark, d).filter("reason is not null").select("doc_id").distinct()


# --- p8: evaluation passages in the corpus ----------------------------------------------------------------------------


@query
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items whose passages they repeat, the share and the spans."""
    items = fixed_rows(table(spark, d, "eval_items").select("item_id", "passage"), 100_000)
    return leak.find_leaks(table(spark, d, "documents"), "doc_id", "text", [(r[0], r[1]) for r in items])


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat at least a third of an item's passage."""
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


# --- p2: text quality of pages ----------------------------------------------------------------------------------------


def _page_quality(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_results").select("source_file_id", "page_number", "text")
    return quality.judge(quality.text_statistics(pages, "text"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are not blank and fail a rule of natural prose."""
    return _page_quality(spark, d).filter("verdict not in ('prose', 'empty')").select("source_file_id", "page_number").distinct()


@query
def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics anew and verdict of every page; copies of a page give one row."""
    cols = "source_file_id page_number char_count printable_ratio alpha_ratio word_count mean_word_length symbol_ratio common_share letter_share stop_words line_count end_punctuation_share bullet_share ellipsis_share body_share verdict".split()
    return _page_quality(spark, d).select(*cols, F.array_join("failed_rules", " ").alias("failed_rules"), F.array_join("notes", " ").alias("notes")).distinct()


# --- p1: incidents and source records of one sighting -------------------------------------------------------------------


@query
def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of incidents and source records that could be one sighting, with the posterior of a match."""
    regions = [(r[0], r[1]) for r in fixed_rows(table(spark, d, "region_zones").select("region", "country"), 1000)]
    phrases = matching.known_phrases(table(spark, d, "incidents"), "shape_description")
    left = matching.prepare(table(spark, d, "incidents"), "a", {"id": "case_id", "place": "location_text", "dated": "occurred_at_text", "day": "occurred_at", "title": "title", "account": "summary", "phrase": "shape_description", "region": "region", "seconds": "duration_seconds", "feet": "altitude_feet"}, regions, phrases)
    right = matching.prepare(table(spark, d, "source_records"), "b", {"id": "identity_key", "place": "incident_location_hint", "dated": "incident_date_hint", "title": "title", "account": "description"}, regions, phrases)
    return matching.match(left, right).select(F.col("a").alias("case_id"), F.col("b").alias("identity_key"), F.round("confidence", 4).alias("confidence"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an incident and a source record that are one sighting."""
    return p1_matches(spark, d).filter("confidence >= 0.5").select("case_id", "identity_key").distinct()


# --- p7: repair of scanned pages ----------------------------------------------------------------------------------------


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that are furniture, end in a cut word or hold a misread word."""
    return repair.line_kinds(table(spark, d, "page_results"), "source_file_id", "page_number", "text")


@query
def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page as continuous readable paragraphs."""
    return repair.repair_pages(table(spark, d, "page_results"), "source_file_id", "page_number", "text")


@query
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Every source file as continuous readable paragraphs, page by page."""
    pages = repair.pages_of(table(spark, d, "source_files"), "id", "ocr_text").distinct()
    done = repair.repair_pages(pages, "id", "page_number", "text")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "repaired")))  # the pages of one text that was one value before
    return done.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["repaired"]), "\n\n").alias("repaired"))


# --- p9: mixing sources to target weights -------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mix.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text").select("doc_id", "source", "tokens")
    return mix.mix(docs, "doc_id", "source", "tokens", table(spark, d, "mix_targets"))


@query
def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with how often each is used."""
    return _mixture(spark, d)[0]


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached and shortfalls of every target."""
    return _mixture(spark, d)[1]
