"""Filters, projections, sorts, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import relational as R
from evidex.plans.registry import Book

book = Book()
add = book.add

# --- filters ----------------------------------------------------------------------------------------------------------


@add("FLT-01", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT'")
def flt01(t):
    return R.facets(t("orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_totalprice")


@add("FLT-02", "SELECT case_id, extracted_at FROM incidents WHERE NOT flagged")
def flt02(t):
    return t("incidents").filter(~F.col("flagged")).select("case_id", "extracted_at")


@add("FLT-03", "SELECT case_id FROM incidents WHERE country IS NOT NULL AND region IS NOT NULL")
def flt03(t):
    return t("incidents").filter("country is not null and region is not null").select("case_id")


@add("FLT-04", "SELECT count(*) AS pending FROM incidents WHERE location_text IS NOT NULL AND region IS NULL AND NOT flagged")
def flt04(t):
    return t("incidents").filter("location_text is not null and region is null and not flagged").agg(F.count(F.lit(1)).alias("pending"))


@add("FLT-05", "SELECT case_id, title FROM incidents WHERE title ILIKE '%light%' OR summary ILIKE '%lantern%' OR location_text ILIKE '%harbour%'")
def flt05(t):
    return R.where(t("incidents"), [("title", "ilike", "%light%"), ("summary", "ilike", "%lantern%"), ("location_text", "ilike", "%harbour%")], any_of=True).select("case_id", "title")


@add("FLT-06", "SELECT id, name FROM entities WHERE contains(lower(name),'captain') OR contains(lower(coalesce(description,'')),'captain')")
def flt06(t):
    return R.text_search(t("entities"), " 'Captain' ", ["name", "description"]).select("id", "name")


@add("FLT-07", "SELECT case_id, occurred_at FROM incidents WHERE occurred_at BETWEEN DATE '1950-01-01' AND DATE '1959-12-31'")
def flt07(t):
    return t("incidents").filter(F.col("occurred_at").between("1950-01-01", "1959-12-31")).select("case_id", "occurred_at")


@add("FLT-08", "SELECT case_id FROM incidents WHERE list_contains(sensor_types,'infrared') AND list_contains(sensor_types,'radar')")
def flt08(t):
    return R.where(t("incidents"), [("sensor_types", "contains_all", ["infrared", "radar"])]).select("case_id")


@add("FLT-09", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity>=40 AND l_returnflag IN ('A','R') AND l_discount<0.05 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def flt09(t):
    spec = [("l_quantity", "gte", 40), ("l_returnflag", "in", ["A", "R"]), ("l_discount", "lt", 0.05)]
    return R.where(t("lineitem"), spec).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_quantity")


@add("FLT-10", "SELECT case_id, occurred_at FROM incidents WHERE occurred_at < DATE '1960-01-01'")
def flt10(t):
    return t("incidents").filter(F.col("occurred_at") < "1960-01-01").orderBy("occurred_at", "case_id").select("case_id", "occurred_at")


@add("FLT-11", "SELECT identity_key, agency FROM source_records WHERE agency IS NULL OR agency IN ('','null')")
def flt11(t):
    return t("source_records").filter(F.col("agency").isNull() | F.col("agency").isin("", "null")).select("identity_key", "agency")


@add("FLT-12", "SELECT case_id, source_file_id FROM incidents WHERE source_file_id IN (SELECT id FROM source_files WHERE agency='FBI')")
def flt12(t):
    return t("incidents").join(t("source_files").filter("agency = 'FBI'").select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select("case_id", "source_file_id")


@add("FLT-13", "SELECT vec_id, other, rank FROM (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND b.vec_id<>a.vec_id) WHERE rank<=4")
def flt13(t):
    """Four nearest other rows of every hundredth vector: the row itself is dropped before the cut."""
    from evidex.operators.retrieval import nearest

    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0")
    return nearest(q, e, "vec_id", "embedding", 4, exclude_self=True).select("vec_id", "other", "rank")


@add("FLT-14", "SELECT item_id, CASE WHEN contains(lower(question),'audio') THEN 'audio' WHEN contains(lower(question),'video') THEN 'video' WHEN contains(lower(question),'image') OR contains(lower(question),'photo') THEN 'image' WHEN contains(lower(question),'sheet') OR contains(lower(question),'log') THEN 'pdf' END AS scope FROM eval_items WHERE regexp_matches(question,'(?i)\\b(how many|list|all|every|which|who)\\b')")
def flt14(t):
    rules = [("audio", "audio"), ("video", "video"), ("image", "image"), ("photo", "image"), ("sheet", "pdf"), ("log", "pdf")]
    return t("eval_items").filter(F.col("question").rlike(r"(?i)\b(how many|list|all|every|which|who)\b")).select("item_id", T.ordered_keyword("question", rules).alias("scope"))


@add("FLT-15", "SELECT identity_key FROM source_records WHERE contains(lower(original_url),'/4853/') OR release_date=DATE '2026-07-04'")
def flt15(t):
    return t("source_records").filter(F.lower("original_url").contains("/4853/") | (F.col("release_date") == "2026-07-04")).select("identity_key")


@add("FLT-16", "SELECT case_id, title FROM incidents WHERE lower(case_id)=lower((SELECT min(case_id) FROM incidents)) ORDER BY case_id, extracted_at LIMIT 1")
def flt16(t):
    i = t("incidents")
    one = i.agg(F.lower(F.min("case_id")).alias("k"))
    return i.join(F.broadcast(one), F.lower("case_id") == F.col("k")).orderBy("case_id", "extracted_at").limit(1).select("case_id", "title")


@add("FLT-17", "SELECT DISTINCT which, url FROM (SELECT 'original' AS which, original_url AS url FROM source_records UNION ALL SELECT 'file', url FROM source_files) WHERE url LIKE 'https://files.skyrecords.example/%' AND url NOT IN (SELECT url FROM source_files WHERE url IS NOT NULL)")
def flt17(t):
    u = t("source_records").select(F.lit("original").alias("which"), F.col("original_url").alias("url")).unionByName(t("source_files").select(F.lit("file").alias("which"), "url"))
    return u.filter(F.col("url").startswith("https://files.skyrecords.example/")).distinct().join(t("source_files").select("url"), "url", "left_anti").select("which", "url")


@add("FLT-18", "SELECT id FROM entities WHERE id<>(SELECT min(id) FROM entities) ORDER BY id LIMIT 4")
def flt18(t):
    e = t("entities")
    return e.join(F.broadcast(e.agg(F.min("id").alias("own"))), F.col("id") != F.col("own")).orderBy("id").limit(4).select("id")


# --- projections ------------------------------------------------------------------------------------------------------


@add("PRJ-01", "SELECT case_id, coalesce(title,'Untitled') AS title, strftime(occurred_at,'%Y-%m-%d') AS day, coalesce(altitude_feet,0) AS feet, coalesce(array_to_string(sensor_types,','),'') AS sensors FROM incidents")
def prj01(t):
    return t("incidents").select("case_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), F.coalesce("altitude_feet", F.lit(0)).alias("feet"), F.coalesce(F.array_join("sensor_types", ","), F.lit("")).alias("sensors"))


@add("PRJ-02", "SELECT case_id, CASE resolution_status WHEN 'unresolved' THEN 'Open' ELSE replace(resolution_status,'_',' ') END AS label FROM incidents")
def prj02(t):
    return t("incidents").select("case_id", T.lookup("resolution_status", {"unresolved": "Open"}, F.translate("resolution_status", "_", " ")).alias("label"))


@add("PRJ-03", r"SELECT event_id, regexp_replace(coalesce(label,''),'#ep\d+','','g') AS label FROM canonical_events")
def prj03(t):
    return t("canonical_events").select("event_id", T.event_label(F.concat(F.col("label"), F.lit(" / doc-1.pdf#ep2"))).alias("label"))


@add("PRJ-04", "SELECT case_id, CASE WHEN length(summary)>150 THEN substr(summary,1,147)||'...' ELSE summary END AS short FROM incidents")
def prj04(t):
    return t("incidents").select("case_id", T.truncated("summary").alias("short"))


@add("PRJ-05", r"SELECT identity_key, len(regexp_extract_all(coalesce(incident_date_hint,'')||' [REDACTED] '||title,'\[[A-Z][A-Z ]*\]')) AS marks FROM source_records WHERE title IS NOT NULL")
def prj05(t):
    s = F.concat(F.coalesce("incident_date_hint", F.lit("")), F.lit(" [REDACTED] "), "title")
    return t("source_records").filter("title is not null").select("identity_key", F.size(T.redactions(s)).cast("long").alias("marks"))


@add("PRJ-06", r"SELECT id, CASE WHEN regexp_matches(filename,'^fbi-') THEN 'FBI file '||regexp_extract(filename,'(\d+)\.',1) WHEN regexp_matches(filename,'^(cia|nasa)-') THEN upper(regexp_extract(filename,'^([a-z]+)-',1))||' record' ELSE filename END AS title FROM source_files")
def prj06(t):
    f = F.col("filename")
    title = F.when(f.rlike("^fbi-"), F.concat(F.lit("FBI file "), F.regexp_extract(f, r"(\d+)\.", 1))).when(f.rlike("^(cia|nasa)-"), F.concat(F.upper(F.regexp_extract(f, "^([a-z]+)-", 1)), F.lit(" record"))).otherwise(f)
    return t("source_files").select("id", title.alias("title"))


# --- sorts and limits -------------------------------------------------------------------------------------------------


@add("SRT-01", "SELECT id, release_number, released_at FROM (SELECT DISTINCT id, release_number, released_at FROM source_files) ORDER BY release_number DESC NULLS LAST, released_at DESC NULLS LAST, id LIMIT 30")
def srt01(t):
    return t("source_files").select("id", "release_number", "released_at").distinct().orderBy(F.desc_nulls_last("release_number"), F.desc_nulls_last("released_at"), "id").limit(30)


@add("SRT-02", "SELECT case_id, occurred_at FROM incidents WHERE resolution_status='unresolved' AND occurred_at IS NOT NULL ORDER BY occurred_at DESC, case_id, extracted_at LIMIT 1")
def srt02(t):
    return t("incidents").filter("resolution_status = 'unresolved' and occurred_at is not null").orderBy(F.desc("occurred_at"), "case_id", "extracted_at").limit(1).select("case_id", "occurred_at")


@add("SRT-03", "SELECT c_custkey, c_name, ord FROM customer JOIN (VALUES (42,0),(7,1),(99,2),(13,3)) AS v(k,ord) ON k=c_custkey")
def srt03(t):
    c = t("customer")
    v = c.sparkSession.createDataFrame([(k, i) for i, k in enumerate([42, 7, 99, 13])], "c_custkey long, ord int")
    return c.join(F.broadcast(v), "c_custkey").orderBy("ord").select("c_custkey", "c_name", "ord")  # a list in the call


@add("SRT-04", "SELECT id, filename, coalesce(release_number,0) AS release FROM (SELECT DISTINCT id, filename, release_number FROM source_files) ORDER BY 3 DESC, 2, 1 LIMIT 40")
def srt04(t):
    return t("source_files").select("id", "filename", F.coalesce("release_number", F.lit(0)).alias("release")).distinct().orderBy(F.desc("release"), "filename", "id").limit(40)


@add("SRT-05", "SELECT * FROM (SELECT 'oldest' AS which, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 8) UNION ALL SELECT * FROM (SELECT 'newest', o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8)")
def srt05(t):
    o = t("orders").filter("o_orderdate is not null").select("o_orderkey", "o_orderdate")
    return o.orderBy("o_orderdate", "o_orderkey").limit(8).select(F.lit("oldest").alias("which"), "*").unionByName(o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(8).select(F.lit("newest").alias("which"), "*"))


@add("SRT-06", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 60")
def srt06(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(60).limit(30).select("o_orderkey")


@add("SRT-07", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus='P' ORDER BY o_orderkey LIMIT 8")
def srt07(t):
    """Eight rows and the exact total: the total is an aggregate of its own, not a window over all rows in one task."""
    o = t("orders").filter("o_orderstatus = 'P'")
    return o.orderBy("o_orderkey").limit(8).crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("total")))).select("o_orderkey", "total")  # one row


@add("SRT-08", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_totalprice>100000) WHERE rank<=3")
def srt08(t):
    return R.top_per(t("orders").filter("o_totalprice > 100000"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@add("SRT-09", "SELECT s_suppkey FROM (SELECT l_suppkey AS s_suppkey, max(CASE WHEN l_discount>0.1 THEN 1 ELSE 0 END) AS bad, round(avg(l_discount),6) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ORDER BY bad, d, q DESC, s_suppkey LIMIT 1")
def srt09(t):
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max((F.col("l_discount") > 0.1).cast("int")).alias("bad"), F.round(F.avg("l_discount"), 6).alias("d"), F.sum("l_quantity").alias("q"))
    return s.orderBy("bad", "d", F.desc("q"), "s_suppkey").limit(1).select("s_suppkey")


# --- windows ----------------------------------------------------------------------------------------------------------

_GAP = "SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_EPISODES = f"SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM ({_GAP})"


def _event_episodes(t):
    e = t("events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 30 * 60 * 1_000_000
    return R.episodes(e, ["user_id"], ["ts", "event_id"], gap)


@add("WIN-01", f"SELECT event_id, episode::BIGINT AS episode FROM ({_EPISODES})")
def win01(t):
    return _event_episodes(t).select("event_id", F.col("episode").cast("long").alias("episode"))


@add("WIN-02", "SELECT prev, event_id AS curr, event_type<>pt AS boundary FROM (SELECT event_id, event_type, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prev IS NOT NULL")
def win02(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumn("prev", F.lag("event_id").over(w)).withColumn("pt", F.lag("event_type").over(w))
    return e.filter("prev is not null").select("prev", F.col("event_id").alias("curr"), (F.col("event_type") != F.col("pt")).alias("boundary"))


@add("WIN-03", f"SELECT user_id, episode::BIGINT AS episode, count(*) AS n, string_agg(event_type,' ' ORDER BY ts, event_id) AS types FROM ({_EPISODES}) GROUP BY ALL")
def win03(t):
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return _event_episodes(t).groupBy("user_id", F.col("episode").cast("long").alias("episode")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x["event_type"]), " ").alias("types"))


@add("WIN-04", "SELECT doc_id, CASE WHEN n=1 THEN k WHEN m=1 THEN k||':'||source ELSE k||':'||source||':'||doc_id END AS key FROM (SELECT *, row_number() OVER (PARTITION BY k, n>1, source ORDER BY doc_id) AS m FROM (SELECT doc_id, coalesce(source,'-') AS source, substr(sha256(text),1,24) AS k, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents))")
def win04(t):
    d = t("documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), F.substring(F.sha2("text", 256), 1, 24).alias("k"))
    d = d.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("doc_id")))
    d = d.withColumn("m", F.row_number().over(W.partitionBy("k", F.col("n") > 1, "source").orderBy("doc_id")))
    second = F.concat_ws(":", "k", "source")
    return d.select("doc_id", F.when(F.col("n") == 1, F.col("k")).when(F.col("m") == 1, second).otherwise(F.concat_ws(":", second, F.col("doc_id").cast("string"))).alias("key"))


@add("WIN-05", "SELECT id, slug||substr(sha1(id),1,4+2*least(n-1,18)::INTEGER) AS slug FROM (SELECT id, replace(lower(name),' ','-')||'-' AS slug, row_number() OVER (PARTITION BY replace(lower(name),' ','-') ORDER BY id) AS n FROM entities)")
def win05(t):
    """Slugs made unique: each further row of a slug gets two more digits of its hash."""
    e = t("entities").select("id", F.concat(F.replace(F.lower("name"), F.lit(" "), F.lit("-")), F.lit("-")).alias("slug"))
    n = F.row_number().over(W.partitionBy("slug").orderBy("id"))
    e = e.withColumn("n", n)
    return e.select("id", F.concat("slug", F.substring(F.sha1("id"), F.lit(1), F.lit(4) + 2 * F.least(F.col("n") - 1, F.lit(18)))).alias("slug"))


@add("WIN-06", "SELECT c_custkey, CASE WHEN k=0 THEN 0.0 ELSE round(0.04*cos(radians(k*60.0)),6) END AS dx, CASE WHEN k=0 THEN 0.0 ELSE round(0.04*sin(radians(k*60.0)),6) END AS dy FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS k FROM customer)")
def win06(t):
    return R.ring_offsets(t("customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "dx", "dy")


@add("WIN-07", "SELECT source_file_id, case_id FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY case_id, extracted_at) AS n FROM incidents) WHERE n=1")
def win07(t):
    return R.first_per(t("incidents"), ["source_file_id"], ["case_id", "extracted_at"]).select("source_file_id", "case_id")


# --- sets -------------------------------------------------------------------------------------------------------------


@add("SET-01", "SELECT 'only_customers' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only_orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set01(t):
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return count(c.subtract(o), "only_customers").unionByName(count(c.intersect(o), "both")).unionByName(count(o.subtract(c), "only_orders"))


@add("SET-02", "SELECT k, which FROM (SELECT k, which, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM (SELECT DISTINCT o_custkey AS k, 'orders' AS which, 0 AS p FROM orders UNION ALL SELECT c_custkey, 'customer', 1 FROM customer)) WHERE n=1")
def set02(t):
    a = t("orders").select(F.col("o_custkey").cast("string").alias("k"), F.lit("orders").alias("which"), F.lit(0).alias("pos")).distinct()
    b = t("customer").select(F.col("c_custkey").cast("string").alias("k"), F.lit("customer").alias("which"), F.lit(0).alias("pos"))
    return R.precedence_union([a, b], "k", "pos").select(F.col("k").cast("long").alias("k"), "which")


@add("SET-03", "SELECT k, max(s) AS s FROM (SELECT l_partkey AS k, round(sum(l_quantity),2) AS s FROM lineitem GROUP BY 1 UNION ALL SELECT p_partkey, round(p_retailprice,2) FROM part) GROUP BY k ORDER BY s DESC, k LIMIT 8")
def set03(t):
    a = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("s"))
    u = a.unionByName(t("part").select(F.col("p_partkey").alias("k"), F.round("p_retailprice", 2).alias("s")))
    return u.groupBy("k").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "k").limit(8)


@add("SET-04", "SELECT 'c' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
def set04(t):
    u = t("customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation")).unionByName(t("supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation")))
    return u.groupBy("side", "nation").agg(F.count(F.lit(1)).alias("n"))


@add("SET-05", "SELECT p_partkey, len(list_intersect(a,b)) AS shared, len(list_distinct(list_concat(a,b))) AS together FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name),'[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type),'[a-z0-9]+')) AS b FROM part)")
def set05(t):
    a, b = T.tokens("p_name", 1), T.tokens("p_type", 1)
    return t("part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_union(a, b)).cast("long").alias("together"))


@add("SET-06", "SELECT DISTINCT least(l_partkey,l_suppkey) AS a, greatest(l_partkey,l_suppkey) AS b, l_returnflag AS kind FROM lineitem")
def set06(t):
    return t("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_returnflag").alias("kind")).distinct()


@add("SET-07", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id, case_id, source_filename, role, episode_id FROM event_members)")
def set07(t):
    return t("event_members").dropDuplicates().agg(F.count(F.lit(1)).alias("n"))


@add("SET-08", "SELECT count(*)=0 AS disjoint FROM (SELECT s_name FROM supplier INTERSECT SELECT c_name FROM customer)")
def set08(t):
    return t("supplier").select("s_name").intersect(t("customer").select("c_name")).agg((F.count(F.lit(1)) == 0).alias("disjoint"))
