"""Sources and sinks: what is written is read back, so a query gives the rows that came through."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import relational as R
from evidex.plans.registry import Book
from evidex.session import scratch_dir
from evidex.sources import external as X
from evidex.sources import manifest as M
from evidex.sources import sinks as S

book = Book()
add = book.add

_KIND = {"pdf": "PDF", "video": "VID", "image": "IMG", "audio": "AUD"}


def _csv(t):
    """source_records written as a manifest CSV; its path."""
    s = t("source_records").select(F.date_format("release_date", "M/d/yy").alias("Release Date"), F.col("title").alias("Title"), F.concat(T.lookup("source_type", _KIND, F.lit("OTH")), F.lit(" ")).alias("Type"), F.col("description").alias("Description Blurb"), F.col("agency_raw").alias("Agency"), F.col("incident_location_hint").alias("Incident Location"), F.col("original_url").alias("PDF | Image Link"))
    path = f"{scratch_dir(s.sparkSession)}/csv"
    S.ledger(s, path, s.columns)
    return s.sparkSession, path


@add("SRC-01", "SELECT source_type, count(*) AS n, count(release_date) AS dated FROM (SELECT CASE WHEN source_type IN ('pdf','video','image','audio') THEN source_type ELSE 'other' END AS source_type, release_date FROM source_records) GROUP BY 1")
def src01(t):
    spark, path = _csv(t)
    r = M.manifest_records(M.resolve_headers(M.read_csv(spark, path)), "pursue", {"5/27/26": 2, "7/4/26": 4})
    return r.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count("release_date").alias("dated"))


_SQ = "trim(regexp_replace(coalesce({0},''),'\\s+',' ','g'))"


@add("SRC-02", f"SELECT {_SQ.format('title')} AS title, {_SQ.format('description')} AS description, '' AS featured FROM source_records")
def src02(t):
    spark, path = _csv(t)
    return M.resolve_headers(M.read_csv(spark, path)).select("title", "description", "featured")


@add("SRC-03", "SELECT count(*) AS n, 'second' AS used, true AS has_bytes, 'refused' AS mirror FROM source_records")
def src03(t):
    """A manifest from the first readable place, with the bytes read; a mirror only where it is asked for."""
    spark, path = _csv(t)
    df, used = M.first_readable(spark, [path + "-missing", path])
    size = M.bytes_at(spark, used)
    try:
        M.first_readable(spark, [path + "-missing"], mirror=path)
        mirror = "taken"
    except FileNotFoundError:
        mirror = "refused"
    allowed, from_ = M.first_readable(spark, [path + "-missing"], mirror=path, use_mirror=True)
    ok = size > 0 and from_ == path and allowed.columns == df.columns
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit("second" if used == path else "first").alias("used"), F.lit(ok).alias("has_bytes"), F.lit(mirror).alias("mirror"))


@add("SRC-04", r"SELECT original_url AS url, regexp_extract(original_url,'([^/]*)$',1) AS filename, CASE regexp_extract(original_url,'\.([A-Za-z0-9]+)$',1) WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS file_type, CASE WHEN contains(lower(coalesce(title,'')||' '||original_url),'disc') THEN 'DISC' ELSE 'USG' END AS agency FROM source_records WHERE regexp_matches(original_url,'^https?://')")
def src04(t):
    return M.legacy_rows(t("source_records"), "original_url", "title", [("disc", "DISC")])


@add("SRC-05", "SELECT url, 'file' AS which FROM source_files WHERE url IS NOT NULL UNION ALL SELECT original_url, 'record' FROM source_records WHERE source_type='pdf' AND original_url IS NOT NULL AND original_url NOT IN (SELECT url FROM source_files WHERE url IS NOT NULL)")
def src05(t):
    a = t("source_files").filter("url is not null").select("url", F.lit("file").alias("which"))
    b = t("source_records").filter("original_url is not null").select(F.col("original_url").alias("url"), F.lit("record").alias("which"), "source_type")
    return M.supplement(a, b, "url", F.col("source_type") == "pdf").select("url", "which")


@add("SRC-06", "SELECT event_id, user_id, event_type, 0 AS missing FROM events")
def src06(t):
    e = t("events").select("event_id", "user_id", "event_type")
    root = scratch_dir(e.sparkSession)
    e.write.json(f"{root}/events")
    schema = "event_id long, user_id long, event_type string"
    none = M.read_json(e.sparkSession, f"{root}/absent", schema)
    return M.read_json(e.sparkSession, f"{root}/events", schema).unionByName(none).select("*", F.lit(0).alias("missing"))


@add("SRC-07", "SELECT case_id, CASE WHEN a THEN 'R2' ELSE 'R3' END AS release FROM (SELECT case_id, bool_or(flagged) AS a FROM incidents GROUP BY 1)")
def src07(t):
    i = t("incidents").select("case_id", "source_file_id", "flagged")
    return M.releases([("R2", i.filter("flagged")), ("R3", i)], "case_id", ["none"], "source_file_id").select("case_id", "release")


@add("SRC-08", "SELECT case_id, CASE WHEN m THEN 'member' ELSE 'incident' END AS origin FROM (SELECT case_id, bool_or(m) AS m FROM (SELECT upper(trim(case_id)) AS case_id, true AS m FROM event_members WHERE case_id IS NOT NULL UNION ALL SELECT case_id, false FROM incidents) GROUP BY 1)")
def src08(t):
    a = t("event_members").select(F.upper(F.trim("case_id")).alias("case_id"), F.lit("member").alias("origin"), F.lit(0).alias("pos")).distinct()
    b = t("incidents").select("case_id", F.lit("incident").alias("origin"), F.lit(0).alias("pos")).distinct()
    return R.precedence_union([a, b], "case_id", "pos").select("case_id", "origin")


_PREF = "SELECT agency, arg_max(id, struct_pack(p:=(lower(trim(file_type))='pdf')::INTEGER, id:=id)) AS id FROM source_files WHERE agency IS NOT NULL GROUP BY 1"


@add("SRC-09", f"WITH w AS ({_PREF}) SELECT w.agency, w.id, (SELECT count(DISTINCT id)-1 FROM source_files f WHERE f.agency=w.agency) AS alternates FROM w")
def src09(t):
    f = t("source_files").filter("agency is not null").groupBy("agency", "id").agg(F.max(F.lower(F.trim("file_type"))).alias("k"))
    return R.prefer(f, "agency", F.col("k") == "pdf", "id", "alternates").select("agency", "id", "alternates")


@add("SRC-10", _PREF.replace("WHERE agency IS NOT NULL", "WHERE agency IS NOT NULL AND url IS NOT NULL"))
def src10(t):
    f = t("source_files").filter("agency is not null and url is not null").withColumn("k", F.lower(F.trim("file_type"))).select("agency", "id", "k").distinct()
    return R.prefer(f, "agency", F.col("k") == "pdf", "id").select("agency", "id")


@add("SRC-11", "SELECT r AS id, 'row '||r AS name FROM (SELECT unnest(range(0, (SELECT count(*) FROM nation)*10 + 7)) AS r)")
def src11(t):
    """A source read page by page by several readers: a stand-in server holds 257 rows and gives at most 20 at a time."""
    n = 25 * 10 + 7  # the nations are 25 at every scale

    def get(start, size):
        return [{"id": i, "name": f"row {i}"} for i in range(start, min(start + size, n))]

    return X.paged_scan(t("nation").sparkSession, get, "id long, name string", 20, 4)


_OCR = """CASE WHEN final_category='native_good' THEN 'keep_native' WHEN r.kind NOT IN ('pdf','image') THEN 'keep_native' WHEN coalesce(p.char_count,0)=0 AND coalesce(p.native_char_count,0)=0 AND trim(coalesce(p.text,''))='' THEN 'failed' WHEN r.kind='image' AND r.byte_size<20000 THEN 'skip_thumbnail' WHEN coalesce(p.printable_ratio,0)>=0.85 AND coalesce(p.alpha_ratio,0)>=0.45 AND coalesce(p.word_count,0)>=15 THEN 'keep_native' ELSE 'ocr' END"""


@add("SRC-14", f"SELECT source_file_id, decision, count(*) AS pages, sum(length(coalesce(text,'')))::BIGINT AS chars FROM (SELECT p.source_file_id, p.text, {_OCR} AS decision FROM (SELECT DISTINCT source_file_id, page_number, final_category, char_count, native_char_count, printable_ratio, alpha_ratio, word_count, text FROM page_results) p JOIN (SELECT id, max(lower(trim(file_type))) AS kind, max(byte_size) AS byte_size FROM source_files GROUP BY 1) r ON r.id=p.source_file_id) GROUP BY ALL")
def src14(t):
    """What is read anew by OCR: pages whose native text fails the quality gate, but no thumbnails and no empty pages; counted by file and decision."""
    r = t("source_files").groupBy(F.col("id").alias("source_file_id")).agg(F.max(F.lower(F.trim("file_type"))).alias("kind"), F.max("byte_size").alias("byte_size"))
    p = t("page_results").select("source_file_id", "page_number", "final_category", "char_count", "native_char_count", "printable_ratio", "alpha_ratio", "word_count", "text").distinct().join(r, "source_file_id")
    return X.ocr_plan(p, "kind", "byte_size").groupBy("source_file_id", "decision").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@add("SRC-15", "SELECT source_file_id||'-'||page_number AS name, page_number AS page, length(coalesce(text,'')) AS chars FROM page_results")
def src15(t):
    name = F.concat_ws("-", "source_file_id", F.col("page_number").cast("string"))
    md = F.concat(F.lit("---\npage: "), F.col("page_number").cast("string"), F.lit("\nkind: ocr\n---\n"), F.coalesce("text", F.lit("")))
    return M.front_matter(t("page_results").select(name.alias("name"), md.alias("md")), "md", "name").select("name", "page", F.length("body").alias("chars"))


@add("SRC-17", "SELECT * FROM (VALUES (1,'front'),(2,'back')) AS v(pos,image)")
def src17(t):
    return t("region").sparkSession.createDataFrame([(1, "front"), (2, "back")], "pos int, image string")


@add("SRC-18", "SELECT identity_key, release_number FROM (SELECT DISTINCT identity_key, release_number FROM source_records WHERE status='active' AND source_type='pdf') ORDER BY release_number NULLS LAST, identity_key LIMIT 25")
def src18(t):
    r = t("source_records").filter("status = 'active' and source_type = 'pdf'").select("identity_key", "release_number").distinct()
    return M.queue(r, F.lit(True), [F.col("release_number").asc_nulls_last(), "identity_key"], 25)


@add("SRC-19", "SELECT f.id, CASE WHEN p.n IS NOT NULL THEN 'pages' WHEN f.ocr_text IS NOT NULL THEN 'file' ELSE 'empty' END AS used FROM (SELECT DISTINCT id, ocr_text FROM source_files) f LEFT JOIN (SELECT source_file_id, count(*) AS n FROM page_results WHERE text<>'' GROUP BY 1) p ON p.source_file_id=f.id")
def src19(t):
    p = t("page_results").filter("text <> ''").groupBy(F.col("source_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return t("source_files").select("id", "ocr_text").distinct().join(p, "id", "left").select("id", F.when(F.col("n").isNotNull(), "pages").when(F.col("ocr_text").isNotNull(), "file").otherwise("empty").alias("used"))


@add("SRC-20", "SELECT agency, x.id AS id, x.filename AS filename, x.file_type AS file_type, x.url AS url FROM (SELECT agency, arg_max(struct_pack(id:=id, filename:=filename, file_type:=file_type, url:=url), struct_pack(p:=coalesce(released_at, TIMESTAMP '1900-01-01'), i:=id)) AS x FROM source_files WHERE agency IS NOT NULL GROUP BY 1)")
def src20(t):
    """Of the rows of a key the last in order wins, with all its fields."""
    f = t("source_files").filter("agency is not null").select("agency", "id", "filename", "file_type", "url", F.coalesce("released_at", F.lit("1900-01-01").cast("timestamp")).alias("pos")).distinct()
    return R.prefer(f.withColumn("order", F.struct("pos", "id")), "agency", F.lit(True), "order").select("agency", "id", "filename", "file_type", "url")


@add("SRC-21", "SELECT DISTINCT r.identity_key, CASE WHEN f.byte_size IS NULL THEN 'missing' WHEN f.has THEN 'skip' ELSE 'backfill' END AS status FROM (SELECT DISTINCT identity_key, byte_size FROM source_records) r LEFT JOIN (SELECT byte_size, bool_or(ocr_text IS NOT NULL) AS has FROM source_files GROUP BY 1) f USING (byte_size)")
def src21(t):
    f = t("source_files").groupBy("byte_size").agg(F.bool_or(F.col("ocr_text").isNotNull()).alias("has"))
    r = t("source_records").select("identity_key", "byte_size").distinct().join(f, "byte_size", "left")
    return r.select("identity_key", F.when(F.col("has").isNull(), "missing").when(F.col("has"), "skip").otherwise("backfill").alias("status")).distinct()


@add("SRC-22", "SELECT DISTINCT i.case_id, coalesce(f.filename,'local:'||i.case_id) AS source FROM incidents i LEFT JOIN (SELECT DISTINCT id, filename FROM source_files) f ON f.id=i.source_file_id WHERE NOT i.flagged")
def src22(t):
    f = t("source_files").select(F.col("id").alias("source_file_id"), "filename").distinct()
    i = t("incidents").filter("not flagged").select("case_id", "source_file_id").distinct().join(f, "source_file_id", "left")
    return i.select("case_id", F.coalesce("filename", F.concat(F.lit("local:"), F.col("case_id"))).alias("source")).distinct()


@add("SRC-23", "SELECT k, max(v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY 1")
def src23(t):
    a, b = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return M.last_map([a, b], "k", "v")


@add("SRC-24", "SELECT id, coalesce(r.bytes, b.bytes) AS bytes FROM (SELECT id, max(byte_size) AS bytes FROM source_files GROUP BY 1) b LEFT JOIN (SELECT id, max(byte_size)*2 AS bytes FROM source_files WHERE release_number=4 GROUP BY 1) r USING (id)")
def src24(t):
    b = t("source_files").groupBy("id").agg(F.max("byte_size").alias("bytes")).withColumn("pos", F.lit(0))
    r = t("source_files").filter("release_number = 4").groupBy("id").agg((F.max("byte_size") * 2).alias("bytes")).withColumn("pos", F.lit(0))
    return M.last_values(b, r, "id", "pos", ["bytes"]).select("id", "bytes")


@add("SRC-25", "SELECT 'pages' AS origin, coalesce(word_count,0) AS words, count(*) AS n FROM page_results GROUP BY 2 UNION ALL SELECT 'items', len(regexp_extract_all(passage,'[A-Za-z]{2,}')), count(*) FROM eval_items GROUP BY 2")
def src25(t):
    a = t("page_results").select(F.lit("pages").alias("origin"), F.coalesce("word_count", F.lit(0)).alias("words"))
    b = t("eval_items").select(F.lit("items").alias("origin"), F.regexp_count("passage", F.lit("[A-Za-z]{2,}")).alias("words"))
    return a.unionByName(b).groupBy("origin", "words").agg(F.count(F.lit(1)).alias("n"))


@add("SRC-26", "SELECT f.id, coalesce(p.n, length(f.t)) AS chars, CASE WHEN p.n IS NOT NULL THEN 'pages' ELSE 'file' END AS root FROM (SELECT id, max(ocr_text) AS t, max(lower(trim(file_type))) AS kind FROM source_files GROUP BY 1) f LEFT JOIN (SELECT source_file_id, sum(length(text))::BIGINT AS n FROM (SELECT DISTINCT source_file_id, page_number, text FROM page_results WHERE text<>'') GROUP BY 1) p ON p.source_file_id=f.id WHERE kind<>'video' AND coalesce(p.n, length(f.t)) IS NOT NULL AND f.id NOT IN (SELECT source_file_id FROM incidents WHERE source_file_id IS NOT NULL)")
def src26(t):
    """Texts for the linker: of files that hold no incidents, from the first root that has one, pages before the file."""
    f = t("source_files").groupBy("id").agg(F.max("ocr_text").alias("t"), F.max(F.lower(F.trim("file_type"))).alias("kind"))
    p = t("page_results").filter("text <> ''").select("source_file_id", "page_number", "text").distinct().groupBy(F.col("source_file_id").alias("id")).agg(F.sum(F.length("text")).alias("n"))
    seen = t("incidents").filter("source_file_id is not null").select(F.col("source_file_id").alias("id")).distinct()
    j = f.filter("kind <> 'video'").join(seen, "id", "left_anti").join(p, "id", "left").withColumn("chars", F.coalesce("n", F.length("t").cast("long")))
    return j.filter("chars is not null").select("id", "chars", F.when(F.col("n").isNotNull(), "pages").otherwise("file").alias("root"))


@add("SRC-27", "SELECT location_text, CASE WHEN length(location_text)%4<>0 THEN length(location_text)::DOUBLE END AS lat FROM (SELECT DISTINCT location_text FROM incidents WHERE location_text IS NOT NULL AND region IS NULL)")
def src27(t):
    """Places without coordinates, looked up once each, with a pause between the calls of a task; a stand-in gazetteer knows three of four lengths."""
    q = t("incidents").filter("location_text is not null and region is null").select("location_text").distinct()
    return X.look_up(q, "location_text", lambda s: float(len(s)) if len(s) % 4 else None, lambda s: None).select("location_text", F.col("found").alias("lat"))


# --- sinks ------------------------------------------------------------------------------------------------------------


@add("SNK-01", "SELECT count(*) AS rows FROM orders")
def snk01(t):
    o = t("orders")
    return S.snapshot(o, scratch_dir(o.sparkSession), "2026-09-18").select("rows")


@add("SNK-02", "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def snk02(t):
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    path = scratch_dir(o.sparkSession)
    S.upsert(o.sparkSession, path, o, ["o_orderkey"])
    fresh = o.filter("o_orderkey % 3 = 0").withColumn("status", F.lit("X"))
    return S.upsert(o.sparkSession, path, fresh.unionByName(fresh), ["o_orderkey"])


@add("SNK-03", "SELECT DISTINCT url FROM source_files WHERE url IS NOT NULL UNION SELECT DISTINCT original_url FROM source_records WHERE original_url IS NOT NULL")
def snk03(t):
    a, b = t("source_files").filter("url is not null").select("url").distinct(), t("source_records").filter("original_url is not null").select(F.col("original_url").alias("url")).distinct()
    return R.insert_absent(a, b, "url")


@add("SNK-04", "SELECT doc_id, CASE WHEN n>1 THEN code||upper(substr(sha1(doc_id::VARCHAR),7,4)) ELSE code END AS code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS n FROM (SELECT doc_id, upper(substr(sha1(text),1,6)) AS code FROM documents))")
def snk04(t):
    d = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("s"), F.upper(F.substring(F.sha1("text"), 1, 6)).alias("code"))
    return R.extend_collisions(d, "code", "s", "doc_id").select("doc_id", "code")


@add("SNK-05", "SELECT n_nationkey, n_name FROM nation")
def snk05(t):
    n = t("nation")
    path = scratch_dir(n.sparkSession)
    S.ledger(n.withColumn("extra", F.lit(1)), path, ["n_nationkey", "n_name"])
    return n.sparkSession.read.schema("n_nationkey int, n_name string").csv(path, header=True)


@add("SNK-06", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def snk06(t):
    n = t("nation")
    root = scratch_dir(n.sparkSession)
    names = S.report({"nation": n, "region": t("region")}, root)
    back = [n.sparkSession.read.json(f"{root}/{x}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("name"), "n") for x in names]
    return back[0].unionByName(back[1])


@add("SNK-07", "SELECT v, count(*) AS n FROM orders, (VALUES (0),(1),(2)) AS p(v) WHERE o_orderkey%3<=v GROUP BY 1")
def snk07(t):
    """A cumulative result that is written anew after every part: each version holds all parts so far."""
    o = t("orders").select("o_orderkey")
    path = scratch_dir(o.sparkSession)
    out = None
    for k in range(3):
        v = S.checkpoint_part(o.sparkSession, path, o.filter(F.col("o_orderkey") % 3 == k)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("v"), "n")
        out = v if out is None else out.unionByName(v)
    return out


@add("SNK-08", "SELECT s_suppkey, 'name' AS \"column\", s_name AS old, upper(s_name) AS new FROM supplier WHERE s_name<>upper(s_name)")
def snk08(t):
    s = t("supplier").select("s_suppkey", F.col("s_name").alias("name"), "s_nationkey")
    return S.changes(s, s.withColumn("name", F.upper("name")), "s_suppkey", ["name", "s_nationkey"])


@add("SNK-09", "SELECT s_nationkey, CASE WHEN s_nationkey=3 THEN 0 ELSE count(*) END AS n FROM supplier WHERE s_nationkey<>3 GROUP BY 1 UNION ALL SELECT 3, 1")
def snk09(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    path = scratch_dir(s.sparkSession)
    S.refresh_partitions(s, path, ["s_nationkey"])
    S.refresh_partitions(s.sparkSession.createDataFrame([(1, 3)], "s_suppkey long, s_nationkey int"), path, ["s_nationkey"])
    return s.sparkSession.read.parquet(path).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@add("SNK-11", "SELECT event_type, count(*)*2 AS n FROM events GROUP BY 1")
def snk11(t):
    e = t("events").select("event_id", "event_type")
    path = scratch_dir(e.sparkSession)
    S.append_log(e, path)
    S.append_log(e, path)
    return e.sparkSession.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@add("SNK-12", "SELECT url, min(p) AS p FROM (SELECT url, '0'||id AS p FROM source_files WHERE url IS NOT NULL UNION ALL SELECT original_url, '1'||identity_key FROM source_records WHERE original_url IS NOT NULL) GROUP BY 1")
def snk12(t):
    """Addresses of a site map, each once, at the place where it first stands: files before records, each by id."""
    at = lambda df, c, n, i: df.filter(f"{c} is not null").select(F.col(c).alias("url"), F.concat(F.lit(n), F.col(i)).alias("p"))
    u = at(t("source_files"), "url", "0", "id").unionByName(at(t("source_records"), "original_url", "1", "identity_key"))
    return u.groupBy("url").agg(F.min("p").alias("p"))


@add("SNK-13", "SELECT url, CASE WHEN pmod THEN 'failed' ELSE 'stored' END AS status, CASE WHEN pmod THEN 2 ELSE 1 END AS tries, CASE WHEN pmod THEN NULL ELSE 'sha-'||length(url) END AS digest FROM (SELECT DISTINCT url, length(url)%3=0 AS pmod FROM source_files WHERE url IS NOT NULL)")
def snk13(t):
    """Fetched assets kept by address: what was stored stays with its first stamp, what failed is tried again and counted."""
    u = t("source_files").filter("url is not null").select("url").distinct()
    path = scratch_dir(u.sparkSession)
    for _ in range(2):
        fails = F.length("url") % 3 == 0
        kept = S.upsert_assets(u.sparkSession, path, u.select("url", ~fails, F.when(~fails, F.concat(F.lit("sha-"), F.length("url").cast("string")))).toDF("url", "ok", "digest"), "2026-01-01")
    return kept.select("url", "status", "tries", "digest")


# --- the outside world, with a stand-in for the call ------------------------------------------------------------------


@add("SRC-12", r"SELECT DISTINCT url, (coalesce(try_cast(regexp_extract(url,'(\d)[^\d]*$',1) AS INTEGER),0)%4+1)::INTEGER AS attempts FROM source_files WHERE url IS NOT NULL")
def src12(t):
    """Fetching with retries: a stand-in server answers at an attempt that the address tells."""
    import re

    def get(url, attempt):
        m = re.search(r"(\d)[^\d]*$", url)
        return b"ok" if attempt > (int(m[1]) if m else 0) % 4 else None

    return X.fetch(t("source_files"), "url", get, lambda s: None).select("url", "attempts")


@add("SRC-13", r"""SELECT id, page, CASE WHEN length(body)<100 THEN 'ocr' ELSE 'native' END AS method FROM (SELECT id, unnest(range(1,len(l)+1))::INTEGER AS page, unnest(l) AS body FROM (SELECT id, string_split(ocr_text, '--- PAGE ') AS l FROM (SELECT DISTINCT id, ocr_text FROM source_files WHERE ocr_text IS NOT NULL)))""")
def src13(t):
    """Pages of documents with a stand-in for the PDF reader and for OCR."""
    f = t("source_files").filter("ocr_text is not null").select("id", F.encode("ocr_text", "utf-8").alias("content")).distinct()
    return X.extract_pages(f, "id", "content", lambda b: b.decode().split("--- PAGE "), lambda b, n: "").select("id", "page", "method")


@add("SRC-16", "SELECT * FROM (VALUES ('aaro','not implemented'),('nara','not implemented'),('pursue','ready')) AS v(provider,status)")
def src16(t):
    p = X.Providers(pursue=lambda spark, path: M.read_csv(spark, path), aaro=None, nara=None)
    return t("region").sparkSession.createDataFrame(p.status(), "provider string, status string")


@add("SNK-10", "SELECT count(*) AS n, sum(length(n_name))::BIGINT AS chars FROM nation")
def snk10(t):
    n = t("nation")
    path = f"{scratch_dir(n.sparkSession)}/one/names.txt"
    X.write_atomically(n.sparkSession, path, "\n".join(r[0] for r in n.select("n_name").collect()).encode())  # a fixed table of 25 rows
    return n.sparkSession.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@add("EVD-11", "SELECT item_id, CASE WHEN item_id%3<>0 THEN 'answered' WHEN item_id%2=0 THEN 'repaired' ELSE 'abstained' END AS outcome, CASE WHEN item_id%3<>0 THEN 1 ELSE 2 END AS calls FROM eval_items")
def evd11(t):
    """One repair, then abstention: a stand-in model cites a wrong id for every third question and mends every second of those."""
    import pandas as pd

    def run(it):
        for pdf in it:
            rows = []
            for i in pdf["item_id"]:
                ask = lambda q, wrong, i=i: ["A-1"] if i % 3 or (wrong and i % 2 == 0) else ["X-9"]
                rows.append((i, *X.answer_or_abstain(ask, "", {"A-1"})))
            yield pd.DataFrame(rows, columns=["item_id", "outcome", "calls"])

    return t("eval_items").select("item_id").mapInPandas(run, "item_id long, outcome string, calls int")
