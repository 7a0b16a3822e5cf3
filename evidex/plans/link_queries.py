"""Linking fragments into events and series, and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import linking as L
from evidex.operators import relational as R
from evidex.operators import retrieval as Q
from evidex.operators.matching_rules import ladder
from evidex.plans.registry import Book
from evidex.session import fixed_rows

book = Book()
add = book.add

_MEM = "SELECT DISTINCT event_id, upper(trim(case_id)) AS case_id, source_filename, role FROM event_members WHERE case_id IS NOT NULL"


def _members(t):
    return t("event_members").filter("case_id is not null").select("event_id", F.upper(F.trim("case_id")).alias("case_id"), "source_filename", "role").distinct()


_FILES = "files AS (SELECT DISTINCT filename AS file, lower(trim(file_type)) AS kind FROM source_files WHERE filename IS NOT NULL)"
_WORDS_OF = "SELECT DISTINCT case_id, t AS place, coalesce(strftime(occurred_at,'%Y'),'') AS year FROM (SELECT case_id, occurred_at, unnest(regexp_extract_all(coalesce(location_text,''),'[A-Z][a-z]{4,}')) AS t FROM incidents) WHERE t NOT IN (SELECT * FROM wide)"
_CANDIDATES = f"""m AS ({_MEM}), {_FILES}, wide AS (SELECT unnest(string_split(region||' '||country,' ')) FROM region_zones), w AS ({_WORDS_OF}),
pairing AS (SELECT DISTINCT 'catalog_pairing' AS kind, x.source_filename AS "left", y.f AS "right", NULL AS band, '' AS label FROM m x JOIN (SELECT event_id, min(source_filename) AS f FROM m WHERE role='observation' AND source_filename IS NOT NULL GROUP BY 1) y USING (event_id) WHERE x.role='media' AND x.source_filename<>y.f),
series AS (SELECT DISTINCT 'series_identifier' AS kind, source_filename AS "left", lower(split_part(label,' / ',1)) AS "right", NULL AS band, label FROM m JOIN canonical_events c USING (event_id) WHERE source_filename IS NOT NULL AND label IS NOT NULL),
text AS (SELECT id, max(filename) AS filename, max(ocr_text) AS ocr_text FROM source_files WHERE lower(trim(file_type))='webpage' AND ocr_text IS NOT NULL GROUP BY 1),
named AS (SELECT filename, place, max(n) AS n, bool_or(contains(substr(ocr_text,1,800),place)) AS lead FROM (SELECT id, filename, ocr_text, t AS place, count(*) AS n FROM (SELECT id, filename, ocr_text, unnest(regexp_extract_all(ocr_text,'[A-Z][a-z]{4,}')) AS t FROM text) GROUP BY ALL) GROUP BY ALL),
analysis AS (SELECT 'analysis_place' AS kind, filename AS "left", case_id AS "right", CASE WHEN bool_or(n>=2 OR lead) THEN 'strong' ELSE 'medium' END AS band, '' AS label FROM named JOIN w USING (place) GROUP BY ALL),
first AS (SELECT place, year, min(case_id) AS a FROM w WHERE year<>'' GROUP BY ALL),
overlap AS (SELECT DISTINCT 'place_overlap' AS kind, a AS "left", case_id AS "right", NULL AS band, '' AS label FROM w JOIN first USING (place, year) WHERE a<>case_id),
cand AS (SELECT * FROM pairing UNION ALL SELECT * FROM series UNION ALL SELECT * FROM analysis UNION ALL SELECT * FROM overlap)"""


def _candidates(t):
    """The four generators: media files paired with the file of their event, series named by labels, analysis texts that name an incident's place, incidents of one place and year tied to the first of them."""
    m = _members(t)
    seen = m.filter("role = 'observation' and source_filename is not null").groupBy("event_id").agg(F.min("source_filename").alias("right"))
    row = lambda df, kind, band=F.lit(None).cast("string"), label=F.lit(""): df.select(F.lit(kind).alias("kind"), "left", "right", band.alias("band"), label.alias("label"))
    pairing = row(m.filter("role = 'media'").join(seen, "event_id").withColumnRenamed("source_filename", "left").filter(F.col("left") != F.col("right")), "catalog_pairing").distinct()
    c = t("canonical_events").filter("label is not null").select("event_id", "label").distinct()
    series = m.filter("source_filename is not null").join(c, "event_id").select(F.col("source_filename").alias("left"), F.lower(F.split("label", " / ")[0]).alias("right"), "label")
    series = row(series, "series_identifier", label=F.col("label")).distinct()
    wide = [w for r in fixed_rows(t("region_zones").select("region", "country"), 1000) for w in f"{r[0]} {r[1]}".split()]
    words = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("[A-Z][a-z]{4,}"), F.lit(0))
    w = t("incidents").select("case_id", F.explode(words("location_text")).alias("place"), F.coalesce(F.date_format("occurred_at", "yyyy"), F.lit("")).alias("year")).filter(~F.col("place").isin(wide)).distinct()
    text = t("source_files").filter("lower(trim(file_type)) = 'webpage' and ocr_text is not null").groupBy("id").agg(F.max("filename").alias("filename"), F.max("ocr_text").alias("ocr_text"))
    named = text.select("id", "filename", F.substring("ocr_text", 1, 800).alias("lead"), F.explode(words("ocr_text")).alias("place")).groupBy("id", "filename", "place", "lead").agg(F.count(F.lit(1)).alias("n"))
    named = named.groupBy("filename", "place").agg(F.bool_or((F.col("n") >= 2) | F.col("lead").contains(F.col("place"))).alias("prime"))
    hit = named.join(w.select("place", "case_id").distinct(), "place").groupBy(F.col("filename").alias("left"), F.col("case_id").alias("right")).agg(F.bool_or("prime").alias("prime"))
    analysis = row(hit, "analysis_place", F.when(F.col("prime"), "strong").otherwise("medium"))
    dated = w.filter("year <> ''").withColumn("k", F.concat_ws("|", "place", "year"))
    overlap = row(L.star(dated, "k", "case_id").toDF("left", "right"), "place_overlap").distinct()
    return pairing.unionByName(series).unionByName(analysis).unionByName(overlap)


@add("LNK-01", f"WITH {_CANDIDATES} SELECT DISTINCT kind, least(\"left\",\"right\") AS a, greatest(\"left\",\"right\") AS b FROM cand WHERE \"left\"<>\"right\"")
def lnk01(t):
    """Candidates of four generators, undirected and once a kind."""
    c = _candidates(t)
    kinds = ("catalog_pairing", "series_identifier", "analysis_place", "place_overlap")
    return L.candidates({k: c.filter(F.col("kind") == k).select(F.col("left").alias("a"), F.col("right").alias("b")) for k in kinds})


@add("LNK-02", f"WITH m AS ({_MEM}), p AS (SELECT DISTINCT event_id, split_part(label,' / ',1) AS place, substr(split_part(label,' / ',2),1,3) AS decade FROM canonical_events WHERE label IS NOT NULL) SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.place=b.place AND a.decade=b.decade AND a.event_id<>b.event_id WHERE a.event_id IN (SELECT event_id FROM m WHERE role<>'observation')")
def lnk02(t):
    """Other events at the place and decade of an event with more than an observation; only those are looked up."""
    year = F.try_element_at(F.split("label", " / "), F.lit(2))
    p = t("canonical_events").filter("label is not null").select("event_id", F.split("label", " / ")[0].alias("place"), F.substring(F.coalesce(year, F.lit("")), 1, 3).alias("decade")).distinct()
    later = _members(t).filter("role <> 'observation'").select(F.col("event_id").alias("a")).distinct()
    return p.toDF("a", "place", "decade").join(later, "a", "left_semi").join(p.toDF("b", "place", "decade"), ["place", "decade"]).filter("a <> b").select("a", "b").distinct()


@add("LNK-03", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY extracted_at) AS rn FROM incidents), u AS (SELECT source_file_id, case_id, source_page, region, occurred_at FROM i WHERE rn=1),
s AS (SELECT *, CASE WHEN lag(case_id) OVER w IS NULL OR source_page IS NULL OR lag(source_page) OVER w IS NULL OR source_page-lag(source_page) OVER w>1 THEN 1 ELSE 0 END AS st FROM u WINDOW w AS (PARTITION BY source_file_id ORDER BY coalesce(source_page,0), case_id)),
e AS (SELECT *, sum(st) OVER (PARTITION BY source_file_id ORDER BY coalesce(source_page,0), case_id ROWS UNBOUNDED PRECEDING) AS episode FROM s)
SELECT source_file_id, episode::BIGINT AS episode, count(*) AS n, string_agg(case_id,'|' ORDER BY coalesce(source_page,0), case_id) AS members FROM e GROUP BY ALL""")
def lnk03(t):
    i = R.first_per(t("incidents"), ["case_id"], ["extracted_at"]).withColumn("pg", F.coalesce("source_page", F.lit(0)))
    from pyspark.sql import Window as W

    before = F.lag("source_page").over(W.partitionBy("source_file_id").orderBy("pg", "case_id"))
    e = L.events(i, "source_file_id", ["pg", "case_id"], "case_id", "region", "occurred_at", F.col("source_page") - before > 1)
    return e.select("source_file_id", F.col("episode").cast("long").alias("episode"), "n", "members")


_SERIES = {"(?i)^kim": "kim-series", "(?i)^bor": "bor-series"}


@add("LNK-04", f"""WITH {_CANDIDATES}, cls AS (SELECT file, CASE WHEN bool_or(kind IN ('audio','video')) THEN 'media_metadata' ELSE 'report' END AS c, CASE WHEN bool_or(kind='pdf') THEN 'extract' ELSE 'source_only' END AS act FROM files GROUP BY 1),
ce AS (SELECT DISTINCT case_id, event_id FROM m), mf AS (SELECT DISTINCT event_id, source_filename AS file FROM m WHERE source_filename IS NOT NULL),
p AS (SELECT CASE WHEN l.c='media_metadata' AND r.act='extract' THEN "left" WHEN r.c='media_metadata' AND l.act='extract' THEN "right" END AS media, CASE WHEN l.c='media_metadata' AND r.act='extract' THEN "right" WHEN r.c='media_metadata' AND l.act='extract' THEN "left" END AS file FROM pairing LEFT JOIN cls l ON l.file="left" LEFT JOIN cls r ON r.file="right")
SELECT DISTINCT 'media_for_event' AS relationship, 'auto_supported' AS status, media AS "left", event_id AS "right", 'strong' AS band FROM p JOIN mf USING (file) WHERE media IS NOT NULL
UNION SELECT 'analysis_of_event', CASE WHEN band='strong' THEN 'auto_supported' ELSE 'needs_review' END, "left", event_id, band FROM analysis JOIN ce ON ce.case_id="right"
UNION SELECT 'same_series', 'auto_supported', "left", CASE WHEN regexp_matches(label,'(?i)^kim') THEN 'kim-series' ELSE 'bor-series' END, 'strong' FROM series WHERE regexp_matches(label,'(?i)^(kim|bor)')
UNION SELECT 'same_event', 'review_supported', x.event_id, y.event_id, 'medium' FROM overlap JOIN ce x ON x.case_id="left" JOIN ce y ON y.case_id="right" WHERE x.event_id<>y.event_id""")
def lnk04(t):
    """Decisions on the four kinds of candidates."""
    m = _members(t)
    f = t("source_files").filter("filename is not null").groupBy(F.col("filename").alias("file")).agg(F.bool_or(F.lower(F.trim("file_type")).isin("audio", "video")).alias("media"), F.bool_or(F.lower(F.trim("file_type")) == "pdf").alias("pdf"))
    f = f.select("file", F.when(F.col("media"), "media_metadata").otherwise("report").alias("document_class"), F.when(F.col("pdf"), "extract").otherwise("source_only").alias("action"))
    return L.apply_rules(_candidates(t), f, m.filter("source_filename is not null").select("event_id", F.col("source_filename").alias("file")), m.select("case_id", "event_id"), _SERIES)


@add("LNK-05", "WITH g AS (SELECT DISTINCT case_id AS a FROM incidents WHERE location_text IS NULL ORDER BY 1 LIMIT 21) SELECT x.a, y.a AS b FROM g x JOIN g y ON x.a<y.a ORDER BY 1,2 LIMIT 20")
def lnk05(t):
    return L.controls(t("incidents"), "case_id", F.col("location_text").isNull())


@add("LNK-06", "SELECT source_filename, row_number() OVER (PARTITION BY source_filename ORDER BY o, event_id) AS position, event_id FROM (SELECT source_filename, event_id, min(coalesce(case_id,'')) AS o FROM event_members WHERE source_filename IS NOT NULL GROUP BY ALL)")
def lnk06(t):
    m = t("event_members").filter("source_filename is not null").withColumn("o", F.coalesce("case_id", F.lit("")))
    return L.ordered_distinct(m, "source_filename", "event_id", ["o"])


@add("LNK-07", "SELECT DISTINCT event_id, source_filename, role FROM event_members")
def lnk07(t):
    return t("event_members").select("event_id", "source_filename", "role").dropDuplicates()


@add("LNK-08", "SELECT count(*) FILTER (WHERE k>1) AS merged, count(*) FILTER (WHERE k=1) AS single, max(k) AS largest FROM (SELECT event_id, count(DISTINCT case_id) AS k FROM (" + _MEM + ") GROUP BY 1)")
def lnk08(t):
    k = _members(t).groupBy("event_id").agg(F.count_distinct("case_id").alias("k"))
    return k.agg(F.count_if(F.col("k") > 1).alias("merged"), F.count_if(F.col("k") == 1).alias("single"), F.max("k").alias("largest"))


@add("LNK-09", f"SELECT DISTINCT m.event_id, m.case_id, CASE WHEN c.occurred_at=i.occurred_at THEN 'same_day' WHEN year(c.occurred_at)=year(i.occurred_at) THEN 'same_year' ELSE 'other' END AS hint FROM ({_MEM}) m JOIN canonical_events c USING (event_id) JOIN incidents i ON i.case_id=m.case_id WHERE c.occurred_at IS NOT NULL AND i.occurred_at IS NOT NULL")
def lnk09(t):
    c = t("canonical_events").filter("occurred_at is not null").select("event_id", F.col("occurred_at").alias("d")).distinct()
    i = t("incidents").filter("occurred_at is not null").select("case_id", "occurred_at").distinct()
    j = _members(t).join(c, "event_id").join(i, "case_id")
    return j.select("event_id", "case_id", ladder([("same_day", F.col("d") == F.col("occurred_at")), ("same_year", F.year("d") == F.year("occurred_at"))], "other").alias("hint")).distinct()


@add("LNK-10", "SELECT external_id, count(DISTINCT source_type) AS types, count(DISTINCT release_number) AS releases, CASE WHEN count(DISTINCT source_type)>1 THEN 'type_change' WHEN count(DISTINCT release_number)>1 THEN 'reissue' ELSE 'single' END AS evolution FROM source_records WHERE external_id IS NOT NULL GROUP BY 1")
def lnk10(t):
    g = t("source_records").filter("external_id is not null").groupBy("external_id").agg(F.count_distinct("source_type").alias("types"), F.count_distinct("release_number").alias("releases"))
    return g.select("*", ladder([("type_change", F.col("types") > 1), ("reissue", F.col("releases") > 1)], "single").alias("evolution"))


@add("LNK-11", "SELECT title, string_agg(DISTINCT coalesce(release_number,0)||':'||source_type,' ' ORDER BY coalesce(release_number,0)||':'||source_type) AS pairs FROM source_records WHERE title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(release_number,0)||':'||source_type)>1")
def lnk11(t):
    p = F.concat_ws(":", F.coalesce("release_number", F.lit(0)).cast("string"), "source_type")
    return t("source_records").filter("title is not null").groupBy("title").agg(F.sort_array(F.collect_set(p)).alias("p")).filter(F.size("p") > 1).select("title", F.array_join("p", " ").alias("pairs"))  # kinds of releases and types


@add("LNK-12", f"SELECT 'multi_event' AS alarm, count(*) AS n FROM (SELECT case_id FROM ({_MEM}) GROUP BY 1 HAVING count(DISTINCT event_id)>1) UNION ALL SELECT 'no_event_row', count(*) FROM (SELECT DISTINCT event_id FROM event_members WHERE event_id NOT IN (SELECT event_id FROM canonical_events))")
def lnk12(t):
    m = _members(t)
    a = m.groupBy("case_id").agg(F.count_distinct("event_id").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("multi_event").alias("alarm"), "n")
    b = t("event_members").select("event_id").distinct().join(t("canonical_events").select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_event_row").alias("alarm"), "n")
    return a.unionByName(b)


@add("LNK-13", "SELECT c.event_id, CASE WHEN c.event_id IN (SELECT event_id FROM event_members WHERE source_filename LIKE 'fbi-%') THEN 'FBI series' ELSE label END AS label, coalesce(location_text,'unknown') AS place FROM canonical_events c")
def lnk13(t):
    s = t("event_members").filter(F.col("source_filename").startswith("fbi-")).select("event_id", F.lit("FBI series").alias("given")).distinct()
    return t("canonical_events").join(s, "event_id", "left").select("event_id", F.coalesce("given", "label").alias("label"), F.coalesce("location_text", F.lit("unknown")).alias("place"))


@add("LNK-14", "SELECT DISTINCT source_filename, 'incident_report' AS document_class FROM event_members WHERE source_filename IS NOT NULL AND source_filename NOT IN (SELECT filename FROM source_files WHERE filename IS NOT NULL AND lower(trim(file_type))='pdf')")
def lnk14(t):
    m = t("event_members").filter("source_filename is not null").select("source_filename").distinct()
    return m.join(t("source_files").filter("lower(trim(file_type)) = 'pdf'").select(F.col("filename").alias("source_filename")), "source_filename", "left_anti").select("source_filename", F.lit("incident_report").alias("document_class"))


@add("LNK-15", "SELECT filename, arg_max(release_number, id) AS release FROM source_files WHERE release_number IS NOT NULL GROUP BY 1")
def lnk15(t):
    return t("source_files").filter("release_number is not null").groupBy("filename").agg(F.max_by("release_number", "id").alias("release"))


# --- retrieval --------------------------------------------------------------------------------------------------------


def _near(least, k, where="a.vec_id<20"):
    return f"SELECT vec_id, other, similarity, rank FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE {where} AND b.vec_id<>a.vec_id AND round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6)>{least}) WHERE rank<={k}"


@add("RET-01", _near(0.2, 10, "a.vec_id%100=0"))
def ret01(t):
    """Top ten above a threshold for every hundredth vector against all vectors."""
    e = t("embeddings")
    return Q.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 0.2, exclude_self=True)


@add("RET-02")
def ret02(t):
    """Inverted lists over the nearest of fixed centres; recall against brute force is measured in the tests."""
    e = t("embeddings")
    return Q.inverted_lists(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(question),'[a-z0-9]+')), lambda x: length(x)>=4)"


@add("RET-03", f"""SELECT item_id, event_id, score, rank FROM (SELECT item_id, event_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, event_id) AS rank FROM (
SELECT item_id, event_id, sum((CASE WHEN contains(lower(coalesce(label,'')),w) THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(location_text,'')),w) THEN 2.0 ELSE 0 END)*CASE WHEN length(w)>4 THEN 2 ELSE 1 END) AS score
FROM (SELECT item_id, unnest({_WORDS}) AS w FROM eval_items), (SELECT DISTINCT event_id, label, location_text FROM canonical_events) GROUP BY ALL) WHERE score>=4) WHERE rank<=12""")
def ret03(t):
    """Weighted token score of all events for every question of the fixed set of 300."""
    q = t("eval_items").select("item_id", T.tokens("question", 4).alias("toks"))
    c = t("canonical_events").select("event_id", "label", "location_text").distinct()
    s = c.crossJoin(F.broadcast(q)).select("item_id", "event_id", Q.token_score(F.col("toks"), [(F.col("label"), 3), (F.col("location_text"), 2)]).alias("score"))  # a stated query set of 300 rows
    return R.top_per(s.filter("score >= 4"), ["item_id"], [F.desc("score"), "event_id"], 12)


@add("RET-04", "SELECT identity_key, s AS score FROM (SELECT identity_key, CASE WHEN contains(lower(title),'disc') THEN 6.0 ELSE 0 END*0.5 + CASE WHEN contains(lower(coalesce(description,'')),'disc') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(title),'fouler') THEN 3.0*2 ELSE 0 END + CASE WHEN contains(lower(coalesce(description,'')),'fouler') THEN 1.0*2 ELSE 0 END AS s FROM source_records WHERE title IS NOT NULL) WHERE s>=3")
def ret04(t):
    toks = F.array(F.lit("disc"), F.lit("fouler"))
    r = t("source_records").filter("title is not null").select("identity_key", Q.token_score(toks, [(F.col("title"), 3), (F.col("description"), 1)]).alias("score"))
    return r.filter("score >= 3")


@add("RET-05", "SELECT identity_key, s AS score FROM (SELECT identity_key, CASE WHEN contains(lower(coalesce(title,'')),'range fouler') THEN 20 ELSE 0 END + CASE WHEN contains(lower(coalesce(description,'')),'disc') THEN 8 ELSE 0 END AS s FROM source_records WHERE external_id IS NOT NULL) WHERE s>0")
def ret05(t):
    s = F.when(F.lower(F.coalesce("title", F.lit(""))).contains("range fouler"), 20).otherwise(0) + F.when(F.lower(F.coalesce("description", F.lit(""))).contains("disc"), 8).otherwise(0)
    return t("source_records").filter("external_id is not null").select("identity_key", s.alias("score")).filter("score > 0")


@add("RET-06", "SELECT case_id, occurred_at FROM (SELECT DISTINCT case_id, occurred_at FROM incidents WHERE occurred_at BETWEEN DATE '1950-01-01' AND DATE '1959-12-31' AND NOT flagged) ORDER BY occurred_at, case_id LIMIT 8")
def ret06(t):
    """A question about the oldest cases of the fifties as a filter chain."""
    from evidex.plans.intent import answer, plan_question

    return answer(t("incidents").select("case_id", "occurred_at", "flagged", "region", "branch", "resolution_status", "title").distinct(), plan_question("What are the oldest cases of the 1950s?")).select("case_id", "occurred_at")


@add("RET-07", f"SELECT item_id, {_WORDS.replace('>=4', '>=1')}[1] IS NOT NULL AS has, (SELECT w FROM (SELECT unnest({_WORDS}) AS w) ORDER BY length(w) DESC, w LIMIT 1) AS topic FROM eval_items")
def ret07(t):
    return t("eval_items").select("item_id", F.lit(True).alias("has"), Q.longest_phrase(T.tokens("question", 4)).alias("topic"))


@add("RET-08", f"""WITH v AS ({_near(0.2, 10, "a.vec_id%100=0")}), l AS (SELECT a.vec_id, b.vec_id AS other, 5.0 AS score FROM embeddings a JOIN embeddings b ON a.label=b.label AND b.vec_id<>a.vec_id WHERE a.vec_id%100=0),
u AS (SELECT vec_id, other, round(max(score),6) AS score FROM (SELECT vec_id, other, similarity*20.0 AS score FROM v UNION ALL SELECT * FROM l) GROUP BY ALL)
SELECT vec_id, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM u) WHERE rank<=8""")
def ret08(t):
    """Every hundredth item against all items: by vector, and by label, where all have one score, so that besides the query itself and the ten of the vector side only the first eight of a label can come in."""
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0")
    v = Q.nearest(q, e, "vec_id", "embedding", 10, 0.2, exclude_self=True).select("vec_id", "other", "similarity")
    first = R.top_per(e.select("label", F.col("vec_id").alias("other")), ["label"], ["other"], 8 + 10 + 1).drop("rank")
    lex = q.select("vec_id", "label").join(first, "label").filter("vec_id <> other").select("vec_id", "other", F.lit(5.0).alias("score"))
    return Q.hybrid(lex, v, "vec_id", "other", 8)


@add("RET-09", "SELECT event_id, coalesce(label,'-')||' | '||coalesce(strftime(occurred_at,'%Y-%m-%d'),'undated')||' | '||coalesce(location_text,'-') AS block FROM canonical_events")
def ret09(t):
    block = F.concat_ws(" | ", F.coalesce("label", F.lit("-")), F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("undated")), F.coalesce("location_text", F.lit("-")))
    return t("canonical_events").select("event_id", block.alias("block"))


@add("RET-10", f"""WITH v AS ({_near(-2, 5, "a.vec_id%100=0")}), l AS (SELECT a.vec_id, b.vec_id AS other, 10+row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label=b.label AND b.vec_id<>a.vec_id WHERE a.vec_id%100=0),
u AS (SELECT vec_id, other, min(rank) AS r FROM (SELECT vec_id, other, rank FROM v UNION ALL SELECT vec_id, other, rank FROM l WHERE rank<=15) GROUP BY ALL)
SELECT vec_id, other, rank FROM (SELECT vec_id, other, row_number() OVER (PARTITION BY vec_id ORDER BY r, other) AS rank FROM u) WHERE rank<=8""")
def ret10(t):
    """Up to eight items a question: first by similarity, then by label."""
    e = t("embeddings")
    v = Q.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, exclude_self=True).select("vec_id", "other", F.col("rank").alias("r"))
    pairs = e.filter("vec_id % 100 = 0").select("vec_id", "label").join(e.select(F.col("vec_id").alias("other"), "label"), "label").filter("vec_id <> other")
    lex = R.top_per(pairs, ["vec_id"], ["other"], 5).select("vec_id", "other", (F.col("rank") + 10).alias("r"))
    return R.top_per(v.unionByName(lex).groupBy("vec_id", "other").agg(F.min("r").alias("r")), ["vec_id"], ["r", "other"], 8).select("vec_id", "other", "rank")


@add("RET-11", f"SELECT a.vec_id, count(b.vec_id)=0 AS failed FROM (SELECT vec_id, label FROM embeddings WHERE vec_id%100=0) a LEFT JOIN (SELECT n.vec_id, e.label FROM ({_near(-2, 3, 'a.vec_id%100=0')}) n JOIN embeddings e ON e.vec_id=n.other) b ON b.vec_id=a.vec_id AND b.label=a.label GROUP BY 1")
def ret11(t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0")
    hits = Q.nearest(q, e, "vec_id", "embedding", 3, exclude_self=True).join(e.select(F.col("vec_id").alias("other"), F.col("label").alias("found")), "other").select("vec_id", "found")
    ok = q.select("vec_id", "label").join(hits, "vec_id", "left").groupBy("vec_id").agg(F.count_if(F.col("label") == F.col("found")).alias("k"))
    return ok.select("vec_id", (F.col("k") == 0).alias("failed"))


@add("RET-12", "SELECT item_id, least(length(passage),8000) AS chars, 4 AS dims, 0.0::DOUBLE AS last, 2 AS attempts FROM eval_items WHERE passage IS NOT NULL")
def ret12(t):
    """Texts sent to an embedding model in batches, cut to its limit, padded to the stored length, and tried again where the model says it is busy; a stand-in model is busy at first."""
    from evidex.sources.external import Busy, embed

    def call(texts, attempt):
        if attempt == 0:
            raise Busy
        return [[float(len(x)), 1.0, 2.0] for x in texts]

    e = embed(t("eval_items"), "item_id", "passage", call, 3, 4, lambda s: None)
    return e.select("item_id", F.col("vector")[0].cast("int").alias("chars"), F.size("vector").alias("dims"), F.col("vector")[3].cast("double").alias("last"), "attempts")


@add("RET-13", r"SELECT a.item_id, b.item_id AS cached FROM eval_items a JOIN (SELECT min(item_id) AS item_id, regexp_replace(lower(trim(question)),'\s+',' ','g') AS k FROM eval_items GROUP BY 2) b ON b.k=regexp_replace(lower(trim(a.question)),'\s+',' ','g')")
def ret13(t):
    q = t("eval_items").select("item_id", T.fold_excerpt("question").alias("k"))
    return q.join(q.groupBy("k").agg(F.min("item_id").alias("cached")), "k").select("item_id", "cached")


@add("RET-14", "SELECT sha256(user_id::VARCHAR) AS caller, w, n, n>10 AS limited FROM (SELECT user_id, (epoch_us(ts::TIMESTAMP)//60000000)::BIGINT AS w, count(*) AS n FROM events GROUP BY ALL)")
def ret14(t):
    """A fixed-window limit: more than ten events of a caller, known by a hash, in a minute."""
    g = t("events").groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("caller"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("*", (F.col("n") > 10).alias("limited"))


