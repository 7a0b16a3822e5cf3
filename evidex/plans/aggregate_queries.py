"""Aggregations and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators.matching_rules import ladder
from evidex.plans.registry import Book

book = Book()
add = book.add


def n():
    return F.count(F.lit(1)).alias("n")


@add("AGG-01", "SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus='F') AS done, count(*) FILTER (WHERE o_orderstatus='O') AS open, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus='F' THEN o_custkey END) AS done_customers, min(o_orderdate) AS first, max(CASE WHEN o_orderstatus='P' THEN o_orderdate END) AS last_pending, round(sum(o_totalprice),2) AS total, round(avg(o_totalprice),2) AS mean FROM orders")
def agg01(t):
    """Nine figures in one pass."""
    s = F.col("o_orderstatus")
    return t("orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(s == "F", F.col("o_custkey"))).alias("done_customers"), F.min("o_orderdate").alias("first"), F.max(F.when(s == "P", F.col("o_orderdate"))).alias("last_pending"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@add("AGG-02", "SELECT release, sum(n)::BIGINT AS total, string_agg(t||'='||n,' ' ORDER BY t) AS types FROM (SELECT coalesce(release_number,0) AS release, lower(trim(file_type)) AS t, count(*) AS n FROM source_files GROUP BY ALL) GROUP BY release")
def agg02(t):
    g = t("source_files").groupBy(F.coalesce("release_number", F.lit(0)).alias("release"), F.lower(F.trim("file_type")).alias("t")).agg(n())
    return g.groupBy("release").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "t", F.col("n").cast("string")))), " ").alias("types"))


@add("AGG-03", "SELECT source_type, count(*) AS n FROM source_records GROUP BY 1")
def agg03(t):
    return t("source_records").groupBy("source_type").agg(n())


@add("AGG-04", "SELECT coalesce(source,'-') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars, coalesce(string_agg(DISTINCT lower(lang),' ' ORDER BY lower(lang)),'') AS langs FROM documents GROUP BY 1")
def agg04(t):
    return t("documents").groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(n(), F.sum("n_chars").alias("chars"), F.array_join(F.sort_array(F.collect_set(F.lower("lang"))), " ").alias("langs"))


@add("AGG-05", "SELECT r AS release, count(id) AS n FROM range(1,10) AS x(r) LEFT JOIN source_files ON release_number=r GROUP BY r")
def agg05(t):
    f = t("source_files")
    c = f.groupBy(F.col("release_number").cast("long").alias("release")).agg(F.count("id").alias("n"))
    return f.sparkSession.range(1, 10).withColumnRenamed("id", "release").join(c, "release", "left").fillna(0, ["n"])


@add("AGG-06", "SELECT count(DISTINCT upper(trim(m))) AS members, count(DISTINCT event_id) AS events, max(k) AS largest FROM (SELECT event_id, unnest(member_case_ids) AS m, len(member_case_ids) AS k FROM canonical_events)")
def agg06(t):
    return t("canonical_events").select("event_id", F.size("member_case_ids").cast("long").alias("k"), F.explode("member_case_ids").alias("m")).agg(F.count_distinct(F.upper(F.trim("m"))).alias("members"), F.count_distinct("event_id").alias("events"), F.max("k").alias("largest"))


@add("AGG-07", "SELECT 'agency' AS facet, string_agg(DISTINCT agency,'|' ORDER BY agency) AS vals FROM source_records WHERE agency<>'' UNION ALL SELECT 'status', string_agg(DISTINCT status,'|' ORDER BY status) FROM source_records WHERE status<>''")
def agg07(t):
    s = t("source_records").select(F.explode(F.array(F.struct(F.lit("agency").alias("facet"), F.col("agency").alias("v")), F.struct(F.lit("status").alias("facet"), F.col("status").alias("v")))).alias("x")).select("x.*")
    return s.filter(~T.blank("v")).groupBy("facet").agg(F.array_join(F.sort_array(F.collect_set("v")), "|").alias("vals"))


@add("AGG-08", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def agg08(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n())
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["n"])


@add("AGG-09", "SELECT CASE WHEN count(DISTINCT source_file_id)=0 THEN 0 ELSE round(count(*)/count(DISTINCT source_file_id),2) END AS per_source FROM incidents")
def agg09(t):
    return t("incidents").agg(F.coalesce(F.round(F.try_divide(F.count(F.lit(1)), F.count_distinct("source_file_id")), 2), F.lit(0.0)).alias("per_source"))


@add("AGG-10", "SELECT flagged, resolution_status, CASE WHEN f.id IS NOT NULL THEN 'mapped' WHEN source_file_id IS NULL THEN 'no_file' WHEN g.id IS NULL THEN 'unknown_file' ELSE 'other_type' END AS reason, count(*) AS n, count(f.id) AS mapped, count(*)-count(f.id) AS unmapped FROM (SELECT DISTINCT case_id, source_file_id, flagged, resolution_status FROM incidents) LEFT JOIN (SELECT DISTINCT id FROM source_files WHERE file_type='pdf') f ON f.id=source_file_id LEFT JOIN (SELECT DISTINCT id FROM source_files) g ON g.id=source_file_id GROUP BY ALL")
def agg10(t):
    """Flagged and unflagged rows by status: mapped to a document, or why not."""
    i = t("incidents").select("case_id", F.col("source_file_id").alias("id"), "flagged", "resolution_status").distinct()
    f = t("source_files").groupBy("id").agg(F.bool_or(F.coalesce(F.col("file_type") == "pdf", F.lit(False))).alias("m"))
    j = i.join(f, "id", "left")
    why = F.when(F.col("m"), "mapped").when(F.col("id").isNull(), "no_file").when(F.col("m").isNull(), "unknown_file").otherwise("other_type")
    hit = F.count_if(F.coalesce(F.col("m"), F.lit(False)))
    return j.groupBy("flagged", "resolution_status", why.alias("reason")).agg(n(), hit.alias("mapped"), (F.count(F.lit(1)) - hit).alias("unmapped"))


@add("AGG-11", "SELECT source_file_id, sum(CASE WHEN resolution_status='identified' THEN 1 ELSE 0 END)::BIGINT AS identified, sum(CASE WHEN resolution_status='unresolved' THEN 1 ELSE 0 END)::BIGINT AS unresolved, round(sum(CASE WHEN resolution_status='unresolved' THEN 1 ELSE 0 END)/count(*),4) AS rate FROM incidents GROUP BY 1")
def agg11(t):
    s = F.col("resolution_status")
    return t("incidents").groupBy("source_file_id").agg(F.count_if(s == "identified").alias("identified"), F.count_if(s == "unresolved").alias("unresolved"), F.round(F.try_divide(F.count_if(s == "unresolved"), F.count(F.lit(1))), 4).alias("rate"))


@add("AGG-12", "SELECT source_file_id, pages, ocr, round(ocr/pages,4) AS rate, ocr/pages>0.2 AS high FROM (SELECT source_file_id, count(*) AS pages, count(*) FILTER (WHERE text_method='tesseract') AS ocr FROM (SELECT DISTINCT source_file_id, page_number, text_method FROM page_results) GROUP BY 1)")
def agg12(t):
    p = t("page_results").select("source_file_id", "page_number", "text_method").distinct().groupBy("source_file_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("text_method") == "tesseract").alias("ocr"))
    return p.select("*", F.round(F.col("ocr") / F.col("pages"), 4).alias("rate"), (F.col("ocr") / F.col("pages") > 0.2).alias("high"))


@add("AGG-13", "SELECT coalesce(release_number,0) AS release, count(*) AS files, count(*) FILTER (WHERE k=0) AS zero_yield, sum(k)::BIGINT AS cases FROM (SELECT f.id, f.release_number, count(i.case_id) AS k FROM (SELECT DISTINCT id, release_number FROM source_files) f LEFT JOIN (SELECT DISTINCT case_id, source_file_id FROM incidents) i ON i.source_file_id=f.id GROUP BY ALL) GROUP BY 1")
def agg13(t):
    k = t("incidents").select("case_id", F.col("source_file_id").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    f = t("source_files").select("id", "release_number").distinct().join(k, "id", "left").fillna(0, ["k"])
    return f.groupBy(F.coalesce("release_number", F.lit(0)).alias("release")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("k") == 0).alias("zero_yield"), F.sum("k").alias("cases"))


@add("AGG-14", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE mention_count>100 AND description IS NULL) AS bare, count(*) FILTER (WHERE length(name)<6) AS short FROM entities GROUP BY 1")
def agg14(t):
    return t("entities").groupBy("kind").agg(n(), F.count_if((F.col("mention_count") > 100) & F.col("description").isNull()).alias("bare"), F.count_if(F.length("name") < 6).alias("short"))


_PROBLEMS = [("no_excerpt", "length(coalesce(raw_excerpt,''))=0"), ("short_excerpt", "length(coalesce(raw_excerpt,''))<100"), ("no_date", "occurred_at IS NULL"), ("no_place", "location_text IS NULL")]


@add("AGG-15", "SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([" + ",".join(f"CASE WHEN {c} THEN '{p}' END" for p, c in _PROBLEMS) + "], lambda x: x IS NOT NULL)) AS problem FROM incidents) GROUP BY 1")
def agg15(t):
    e = F.length(F.coalesce("raw_excerpt", F.lit("")))
    found = F.array_compact(F.array(F.when(e == 0, "no_excerpt"), F.when(e < 100, "short_excerpt"), F.when(F.col("occurred_at").isNull(), "no_date"), F.when(F.col("location_text").isNull(), "no_place")))
    return t("incidents").select(F.explode(found).alias("problem")).groupBy("problem").agg(n())


@add("AGG-16", "SELECT m.event_id, count(DISTINCT i.occurred_at) AS dates, count(DISTINCT i.region) AS regions FROM (SELECT DISTINCT event_id, upper(trim(case_id)) AS case_id FROM event_members) m JOIN (SELECT DISTINCT case_id, occurred_at, region FROM incidents) i ON i.case_id=m.case_id GROUP BY 1 HAVING count(DISTINCT i.occurred_at)>1 OR count(DISTINCT i.region)>1")
def agg16(t):
    m = t("event_members").select("event_id", F.upper(F.trim("case_id")).alias("case_id")).distinct()
    i = t("incidents").select("case_id", "occurred_at", "region").distinct()
    return m.join(i, "case_id").groupBy("event_id").agg(F.count_distinct("occurred_at").alias("dates"), F.count_distinct("region").alias("regions")).filter("dates > 1 or regions > 1")


@add("AGG-17", "SELECT source_file_id, count(DISTINCT case_id) AS n, count(DISTINCT occurred_at) AS dates FROM incidents GROUP BY 1 HAVING count(DISTINCT case_id)>=10")
def agg17(t):
    return t("incidents").groupBy("source_file_id").agg(F.count_distinct("case_id").alias("n"), F.count_distinct("occurred_at").alias("dates")).filter("n >= 10")


@add("AGG-18", "SELECT occurred_at, place, count(DISTINCT case_id) AS n FROM (SELECT case_id, occurred_at, unnest(list_distinct(regexp_extract_all(lower(coalesce(location_text,'')),'[a-z]{6,}'))) AS place FROM incidents WHERE occurred_at IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT case_id)>=2")
def agg18(t):
    k = t("incidents").filter("occurred_at is not null").select("case_id", "occurred_at", F.explode(T.tokens("location_text", 6, pattern="[a-z]{6,}")).alias("place"))
    return k.groupBy("occurred_at", "place").agg(F.count_distinct("case_id").alias("n")).filter("n >= 2")


@add("AGG-19", "SELECT alarm, subject FROM (SELECT 'many_cases' AS alarm, source_file_id AS subject FROM incidents GROUP BY 2 HAVING count(DISTINCT case_id)>30 UNION ALL SELECT 'many_events', upper(trim(case_id)) FROM event_members WHERE case_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT event_id)>3 UNION ALL SELECT 'no_text', id FROM source_files WHERE ocr_text IS NULL GROUP BY 2)")
def agg19(t):
    a = t("incidents").groupBy(F.col("source_file_id").alias("subject")).agg(F.count_distinct("case_id").alias("k")).filter("k > 30").select(F.lit("many_cases").alias("alarm"), "subject")
    b = t("event_members").filter("case_id is not null").groupBy(F.upper(F.trim("case_id")).alias("subject")).agg(F.count_distinct("event_id").alias("k")).filter("k > 3").select(F.lit("many_events").alias("alarm"), "subject")
    c = t("source_files").filter("ocr_text is null").select(F.lit("no_text").alias("alarm"), F.col("id").alias("subject")).distinct()
    return a.unionByName(b).unionByName(c)


@add("AGG-20", "SELECT upper(trim(case_id)) AS case_id, count(DISTINCT event_id) AS events FROM event_members WHERE case_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_id)>1")
def agg20(t):
    return t("event_members").filter("case_id is not null").groupBy(F.upper(F.trim("case_id")).alias("case_id")).agg(F.count_distinct("event_id").alias("events")).filter("events > 1")


@add("AGG-21", "SELECT event_id FROM (SELECT event_id, occurred_at FROM canonical_events UNION SELECT m.event_id, i.occurred_at FROM event_members m JOIN incidents i ON i.case_id=upper(trim(m.case_id))) WHERE occurred_at IS NOT NULL GROUP BY 1 HAVING count(DISTINCT occurred_at)>1")
def agg21(t):
    m = t("event_members").select("event_id", F.upper(F.trim("case_id")).alias("case_id")).join(t("incidents").select("case_id", "occurred_at"), "case_id").select("event_id", "occurred_at")
    u = t("canonical_events").select("event_id", "occurred_at").unionByName(m).filter("occurred_at is not null")
    return u.groupBy("event_id").agg(F.count_distinct("occurred_at").alias("k")).filter("k > 1").select("event_id")


@add("AGG-22", "SELECT count(*) FILTER (WHERE source_type='pdf') AS pdfs, count(*) FILTER (WHERE source_type='video') AS videos, count(*) FILTER (WHERE source_type='image') AS images, count(external_id) AS with_id FROM source_records")
def agg22(t):
    k = F.col("source_type")
    return t("source_records").agg(F.count_if(k == "pdf").alias("pdfs"), F.count_if(k == "video").alias("videos"), F.count_if(k == "image").alias("images"), F.count("external_id").alias("with_id"))


@add("AGG-23", "SELECT coalesce(agency,'-') AS agency, count(*) AS n, count(*) FILTER (WHERE ocr_text IS NOT NULL) AS cached, count(*) FILTER (WHERE release_number>=6) AS fresh, sum(byte_size)::BIGINT AS bytes FROM source_files GROUP BY 1")
def agg23(t):
    return t("source_files").groupBy(F.coalesce("agency", F.lit("-")).alias("agency")).agg(n(), F.count("ocr_text").alias("cached"), F.count_if(F.col("release_number") >= 6).alias("fresh"), F.sum("byte_size").alias("bytes"))


@add("AGG-24", "SELECT category, count(*) AS n, round(avg(length(passage)),4) AS mean_chars, bool_and(length(question)>0) AS gate FROM eval_items GROUP BY 1")
def agg24(t):
    return t("eval_items").groupBy("category").agg(n(), F.round(F.avg(F.length("passage")), 4).alias("mean_chars"), F.bool_and(F.length("question") > 0).alias("gate"))


_RANKS = "SELECT a.vec_id AS q, b.label=a.label AS ok, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND b.vec_id<>a.vec_id"


def _ranked(t, k=20):
    from evidex.operators.retrieval import nearest

    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0")
    labels = e.select(F.col("vec_id").alias("other"), F.col("label").alias("found"))
    return nearest(q, e, "vec_id", "embedding", k, exclude_self=True).join(labels, "other").join(e.select("vec_id", "label"), "vec_id")


@add("AGG-25", f"SELECT round(avg(CASE WHEN f<=5 THEN 1 ELSE 0 END),4) AS recall5, round(avg(CASE WHEN f<=10 THEN 1 ELSE 0 END),4) AS recall10, round(avg(CASE WHEN f<=20 THEN 1 ELSE 0 END),4) AS recall20, round(avg(coalesce(1/f,0)),4) AS mrr FROM (SELECT q, min(CASE WHEN ok THEN r END) AS f FROM ({_RANKS}) WHERE r<=20 GROUP BY q)")
def agg25(t):
    from evidex.operators.retrieval import reciprocal_rank

    rr = reciprocal_rank(_ranked(t), "vec_id", "rank", F.col("found") == F.col("label"), (5, 10, 20))
    return rr.agg(*(F.round(F.avg(f"recall_at_{k}"), 4).alias(f"recall{k}") for k in (5, 10, 20)), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@add("AGG-26", "SELECT count(*) AS n, round(max(list_max(list_transform(embedding[1:32], lambda x: abs(x::DOUBLE)))),6) AS head, round(max(list_max(list_transform(embedding[33:64], lambda x: abs(x::DOUBLE)))),6) AS tail, count(*) FILTER (WHERE len(embedding)<>64) AS bad FROM embeddings")
def agg26(t):
    from evidex.functions.values import largest

    v = F.col("embedding")
    return t("embeddings").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(largest(v, 1, 32)), 6).alias("head"), F.round(F.max(largest(v, 33, 32)), 6).alias("tail"), F.count_if(F.size(v) != 64).alias("bad"))


@add("AGG-27", "SELECT text_method, final_category, count(*) AS n FROM page_results GROUP BY ALL")
def agg27(t):
    return t("page_results").groupBy("text_method", "final_category").agg(n())


@add("AGG-28", "SELECT CASE WHEN char_count=0 THEN 'skip_empty' WHEN final_category='needs_ocr' THEN 'rerun' ELSE 'keep' END AS route, count(*) AS n, count(DISTINCT source_file_id) AS files FROM page_results GROUP BY 1")
def agg28(t):
    route = ladder([("skip_empty", F.col("char_count") == 0), ("rerun", F.col("final_category") == "needs_ocr")], "keep")
    return t("page_results").groupBy(route.alias("route")).agg(n(), F.count_distinct("source_file_id").alias("files"))


@add("AGG-29", "SELECT lower(trim(file_type)) AS kind, sum(ceil(length(ocr_text)/6000.0))::BIGINT AS calls, round(sum(ceil(length(ocr_text)/6000.0))*0.02,3) AS cost FROM source_files WHERE ocr_text IS NOT NULL GROUP BY 1")
def agg29(t):
    calls = F.sum(F.ceil(F.length("ocr_text") / 6000.0))
    return t("source_files").filter("ocr_text is not null").groupBy(F.lower(F.trim("file_type")).alias("kind")).agg(calls.alias("calls"), F.round(calls * F.lit(0.02), 3).alias("cost"))


@add("AGG-30", "SELECT name, expected, actual FROM (SELECT 'regions' AS name, 5 AS expected, count(*) AS actual FROM region UNION ALL SELECT 'nations', 99, count(*) FROM nation) WHERE expected<>actual")
def agg30(t):
    gate = lambda name, want: t(name[:-1]).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("name"), F.lit(want).alias("expected"), "actual")
    return gate("regions", 5).unionByName(gate("nations", 99)).filter("expected <> actual")


@add("AGG-31", "SELECT coalesce(status,'new') AS status, count(*) AS n FROM source_records GROUP BY 1")
def agg31(t):
    return t("source_records").groupBy(F.coalesce("status", F.lit("new")).alias("status")).agg(n())


@add("AGG-32", "SELECT agency, CASE WHEN bad>0 THEN 'failed' WHEN empty>0 THEN 'unexplained' ELSE 'complete' END AS verdict FROM (SELECT agency, count(*) FILTER (WHERE processed_at<released_at) AS bad, count(*) FILTER (WHERE ocr_text='') AS empty FROM source_files WHERE agency IS NOT NULL GROUP BY 1)")
def agg32(t):
    g = t("source_files").filter("agency is not null").groupBy("agency").agg(F.count_if(F.col("processed_at") < F.col("released_at")).alias("bad"), F.count_if(F.col("ocr_text") == "").alias("empty"))
    return g.select("agency", ladder([("failed", F.col("bad") > 0), ("unexplained", F.col("empty") > 0)], "complete").alias("verdict"))


@add("AGG-33", "SELECT source_file_id FROM (SELECT DISTINCT source_file_id, page_number, char_count FROM page_results) GROUP BY 1 HAVING count(*)<=2 AND sum(char_count)<400")
def agg33(t):
    p = t("page_results").select("source_file_id", "page_number", "char_count").distinct()
    return p.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("k"), F.sum("char_count").alias("c")).filter("k <= 2 and c < 400").select("source_file_id")


@add("AGG-34", "SELECT role, count(*) AS n, count(DISTINCT source_filename) AS files, min(event_id) AS example FROM event_members GROUP BY 1")
def agg34(t):
    return t("event_members").groupBy("role").agg(n(), F.count_distinct("source_filename").alias("files"), F.min("event_id").alias("example"))


@add("AGG-35", "SELECT which, sum(n)::BIGINT AS n FROM (SELECT 'incidents' AS which, count(*) AS n FROM incidents UNION ALL SELECT 'files', count(*) FROM source_files UNION ALL SELECT 'incidents', count(*) FROM event_members) GROUP BY 1")
def agg35(t):
    c = lambda table, name: t(table).agg(n()).select(F.lit(name).alias("which"), "n")
    return c("incidents", "incidents").unionByName(c("source_files", "files")).unionByName(c("event_members", "incidents")).groupBy("which").agg(F.sum("n").alias("n"))


@add("AGG-36", "SELECT v.agency, count(DISTINCT f.id) AS n FROM (VALUES ('FBI'),('CIA'),('XYZ')) AS v(agency) LEFT JOIN source_files f ON f.agency=v.agency GROUP BY 1")
def agg36(t):
    f = t("source_files")
    watch = f.sparkSession.createDataFrame([("FBI",), ("CIA",), ("XYZ",)], "agency string")
    return watch.join(f.groupBy("agency").agg(F.count_distinct("id").alias("n")), "agency", "left").fillna(0, ["n"])


@add("AGG-37", "SELECT id, array_to_string(w,' ') AS warnings FROM (SELECT id, list_filter([CASE WHEN length(ocr_text)<400 THEN 'thin' END, CASE WHEN page_count>=20 THEN 'huge' END], lambda x: x IS NOT NULL) AS w FROM (SELECT DISTINCT id, ocr_text, page_count FROM source_files)) WHERE len(w)>0")
def agg37(t):
    w = F.array_compact(F.array(F.when(F.length("ocr_text") < 400, "thin"), F.when(F.col("page_count") >= 20, "huge")))
    return t("source_files").select("id", "ocr_text", "page_count").distinct().select("id", w.alias("w")).filter(F.size("w") > 0).select("id", F.array_join("w", " ").alias("warnings"))


@add("MTH-05", f"SELECT q AS vec_id, min(CASE WHEN ok THEN r END) AS first, round(coalesce(1/min(CASE WHEN ok THEN r END),0),6) AS rr FROM ({_RANKS}) WHERE r<=20 GROUP BY q")
def mth05(t):
    from evidex.operators.retrieval import reciprocal_rank

    return reciprocal_rank(_ranked(t), "vec_id", "rank", F.col("found") == F.col("label")).select("vec_id", "first", "rr")
