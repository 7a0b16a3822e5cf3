"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import documents as D
from evidex.operators import matching_rules as M
from evidex.operators import relational as R
from evidex.plans.registry import Book
from evidex.session import fixed_rows

book = Book()
add = book.add


@add("JOI-01", "SELECT i.case_id, i.extracted_at, f.filename, f.agency FROM (SELECT DISTINCT * FROM incidents) i LEFT JOIN (SELECT DISTINCT * FROM source_files) f ON f.id=i.source_file_id")
def joi01(t):
    f = t("source_files").distinct().select(F.col("id").alias("source_file_id"), "filename", "agency")
    return t("incidents").distinct().join(f, "source_file_id", "left").select("case_id", "extracted_at", "filename", "agency")


@add("JOI-02", "SELECT i.case_id, f.filename FROM (SELECT DISTINCT case_id, source_file_id, flagged FROM incidents) i LEFT JOIN (SELECT DISTINCT id, filename, file_type FROM source_files) f ON f.id=i.source_file_id WHERE lower(trim(f.file_type)) IN ('image','video') AND NOT i.flagged")
def joi02(t):
    f = t("source_files").select(F.col("id").alias("source_file_id"), "filename", "file_type").distinct()
    i = t("incidents").select("case_id", "source_file_id", "flagged").distinct().filter("not flagged")
    return i.join(f, "source_file_id", "left").filter("lower(trim(file_type)) in ('image', 'video')").select("case_id", "filename")


@add("JOI-03", "SELECT DISTINCT s.identity_key, f.id FROM source_records s LEFT JOIN source_files f ON f.agency=s.agency AND f.release_number=s.release_number AND f.byte_size=s.byte_size WHERE s.status IS NULL OR s.status='active'")
def joi03(t):
    s = t("source_records").filter("status is null or status = 'active'").select("identity_key", "agency", "release_number", "byte_size").distinct()
    f = t("source_files").select("agency", "release_number", "byte_size", "id").distinct()
    return s.join(f, ["agency", "release_number", "byte_size"], "left").select("identity_key", "id").distinct()


@add("JOI-04", "SELECT o_orderkey, coalesce(a.n, b.n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag='R' GROUP BY 1) a ON a.k=o_orderkey LEFT JOIN (SELECT l_orderkey AS k, -count(*) AS n FROM lineitem GROUP BY 1) b ON b.k=o_orderkey")
def joi04(t):
    l = t("lineitem")
    n = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.nullif(F.count_if(F.col("l_returnflag") == "R"), F.lit(0)).alias("a"), (-F.count(F.lit(1))).alias("b"))
    return t("orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b", F.lit(0)).alias("n"))


_COVER = """WITH r AS (SELECT DISTINCT identity_key, original_url, source_type, description, agency FROM source_records),
f AS (SELECT DISTINCT url, id FROM source_files), i AS (SELECT DISTINCT agency FROM source_files WHERE release_number=2)
SELECT r.identity_key, CASE WHEN f.id IS NOT NULL THEN 'file' WHEN r.source_type='video' THEN 'media' WHEN i.agency IS NOT NULL AND r.description IS NOT NULL THEN 'agency_text' WHEN i.agency IS NOT NULL THEN 'agency' WHEN r.description IS NOT NULL THEN 'text' ELSE 'none' END AS bucket
FROM r LEFT JOIN f ON f.url=r.original_url LEFT JOIN i ON i.agency=r.agency"""


@add("JOI-05", _COVER)
def joi05(t):
    """Coverage ledger: joins from several sides, then one bucket by an ordered ladder."""
    r = t("source_records").select("identity_key", "original_url", "source_type", "description", "agency").distinct()
    f = t("source_files").select(F.col("url").alias("original_url"), "id").distinct()
    i = t("source_files").filter("release_number = 2").select("agency", F.lit(True).alias("known")).distinct()
    rules = [("file", F.col("id").isNotNull()), ("media", F.col("source_type") == "video"), ("agency_text", F.col("known") & F.col("description").isNotNull()), ("agency", F.col("known")), ("text", F.col("description").isNotNull())]
    return r.join(f, "original_url", "left").join(i, "agency", "left").select("identity_key", M.ladder(rules, "none").alias("bucket"))


_LEVELS = """WITH r AS (SELECT DISTINCT identity_key, external_id, byte_size, agency, release_number FROM source_records), f AS (SELECT DISTINCT id, byte_size, agency, release_number FROM source_files),
h AS (SELECT r.identity_key, f.id, 0 AS i, 'size' AS level FROM r JOIN f USING (byte_size) UNION ALL SELECT r.identity_key, f.id, 1, 'agency' FROM r JOIN f ON f.agency=r.agency AND f.release_number=r.release_number),
p AS (SELECT identity_key, i, level, count(DISTINCT id) AS candidates, min(id) AS id FROM h GROUP BY ALL),
b AS (SELECT identity_key, arg_min(struct_pack(level:=level, candidates:=candidates, id:=id), i) AS b FROM p GROUP BY 1)
SELECT k.identity_key, CASE WHEN b.b.candidates=1 THEN b.b.id END AS id, coalesce(b.b.level,'none') AS level, coalesce(b.b.candidates,0) AS candidates FROM (SELECT DISTINCT identity_key FROM r) k LEFT JOIN b USING (identity_key)"""


def _cascade(t):
    r, f = t("source_records").select("identity_key", "byte_size", "agency", "release_number").distinct(), t("source_files").select("id", "byte_size", "agency", "release_number").distinct()
    place = F.concat_ws("/", F.nullif(F.col("agency"), F.lit("")), F.col("release_number").cast("string"))
    place = F.when(F.col("agency").isNotNull() & F.col("release_number").isNotNull(), place)
    return M.cascade(r, f, "identity_key", "id", [("size", F.col("byte_size").cast("string"), F.col("byte_size").cast("string")), ("agency", place, place)])


def _catalog(t):
    """source_files as records of a catalog whose addresses, ids and names depart from the files' in several ways, and the files."""
    f = t("source_files").groupBy("id").agg(F.max("url").alias("url"), F.max("filename").alias("filename")).filter("url is not null")
    n = F.pmod(F.conv(F.substring(F.sha1("id"), 1, 6), 16, 10).cast("long"), F.lit(6))
    url = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.upper("url"), F.lit("?x=1"))).when(n == 2, F.concat(F.lit("https://mirror.example/"), "filename")).when(n == 3, F.concat(F.lit("https://mirror.example/video/"), F.substring("id", 1, 2))).when(n == 4, F.concat(F.lit("https://mirror.example/none/"), F.substring("id", 1, 3)))
    left = f.select(F.col("id").alias("record"), F.col("id").alias("pos"), F.coalesce(url, F.substring_index("url", "-", 2)).alias("url"), F.substring("filename", 1, 6).alias("ext"))
    right = f.select("id", F.when(F.substring("id", 1, 1) == "0", F.concat(F.lit("https://mirror.example/none/"), F.substring("id", 1, 3))).otherwise(F.col("url")).alias("url"), F.substring("id", 1, 2).alias("video"), F.substring("filename", 1, 6).alias("ext"), "filename")
    video = F.nullif(F.regexp_extract(F.col("url"), r"/video/(\w+)$", 1), F.lit(""))
    tail = F.lower(F.regexp_extract(F.col("url"), r"([^/]+)$", 1))
    return left, right, [("exact", F.col("url"), F.col("url"), "free"), ("normalized_url", T.url_key("url"), T.url_key("url"), "free"), ("video_id", video, F.col("video"), "unique"), ("external_id", F.col("ext"), F.col("ext"), "unique"), ("basename", tail, F.lower("filename"), "last")]


_URL = r"regexp_replace(regexp_replace(regexp_replace(lower(url),'[?#].*$',''),'/+$',''),'([^:])/{{2,}}','\1/','g')"
_CATALOG = r"""f AS (SELECT id, max(url) AS url, max(filename) AS filename FROM source_files GROUP BY 1 HAVING max(url) IS NOT NULL), n AS (SELECT *, ('0x'||substr(sha1(id),1,6))::BIGINT % 6 AS n FROM f),
l AS (SELECT id AS record, row_number() OVER (ORDER BY id) AS p, substr(filename,1,6) AS ext, CASE n WHEN 0 THEN url WHEN 1 THEN upper(url)||'?x=1' WHEN 2 THEN 'https://mirror.example/'||filename WHEN 3 THEN 'https://mirror.example/video/'||substr(id,1,2) WHEN 4 THEN 'https://mirror.example/none/'||substr(id,1,3) ELSE array_to_string(string_split(url,'-')[1:2],'-') END AS url FROM n),
r AS (SELECT id, CASE WHEN id[1]='0' THEN 'https://mirror.example/none/'||substr(id,1,3) ELSE url END AS url, substr(id,1,2) AS video, substr(filename,1,6) AS ext, filename FROM f),
lk AS (SELECT record, p, unnest([{i:0,m:'free',k:url},{i:1,m:'free',k:regexp_replace(lower(url),'[?].*$','')},{i:2,m:'unique',k:regexp_extract(url,'/video/(\w+)$',1)},{i:3,m:'unique',k:ext},{i:4,m:'last',k:lower(regexp_extract(url,'([^/]+)$',1))}]) AS x FROM l),
rk AS (SELECT id, unnest([{i:0,k:url},{i:1,k:lower(url)},{i:2,k:video},{i:3,k:ext},{i:4,k:lower(filename)}]) AS x FROM r),
h AS (SELECT lk.p, lk.x.i AS i, any_value(lk.x.m) AS m, list(rk.id ORDER BY rk.id) AS ids FROM lk JOIN rk ON rk.x.i=lk.x.i AND rk.x.k=lk.x.k WHERE lk.x.k<>'' GROUP BY ALL)"""
_GREEDY = "WITH RECURSIVE " + _CATALOG + """,
byrow AS (SELECT p, list({i:i,m:m,ids:ids} ORDER BY i) AS hs FROM h GROUP BY 1), todo AS (SELECT l.p, l.record, coalesce(hs,[]) AS hs FROM l LEFT JOIN byrow USING (p)),
go AS (SELECT 0::BIGINT AS p, ''::VARCHAR AS record, []::VARCHAR[] AS used, NULL::STRUCT(i INTEGER, cnt BIGINT, id VARCHAR) AS x
UNION ALL SELECT q.p, q.record, CASE WHEN q.x.id IS NULL THEN q.used ELSE list_append(q.used, q.x.id) END, q.x FROM (
SELECT todo.p, todo.record, go.used, list_filter(list_transform(todo.hs, lambda h: CASE
 WHEN (h.m='free' OR len(h.ids)=1) AND len(list_filter(h.ids, lambda z: NOT list_contains(go.used,z)))=1 THEN {i:h.i, cnt:greatest(1, CASE WHEN h.m='unique' THEN len(h.ids) ELSE 0 END), id:list_filter(h.ids, lambda z: NOT list_contains(go.used,z))[1]}
 WHEN h.m='unique' AND len(h.ids)>1 THEN {i:h.i, cnt:len(h.ids), id:NULL}
 WHEN h.m<>'unique' AND len(list_filter(h.ids, lambda z: NOT list_contains(go.used,z)))>1 THEN {i:h.i, cnt:len(list_filter(h.ids, lambda z: NOT list_contains(go.used,z))), id:NULL} ELSE NULL END), lambda z: z IS NOT NULL)[1] AS x FROM go JOIN todo ON todo.p=go.p+1) q)
SELECT record, x.id AS id, CASE WHEN x IS NULL THEN 'none' WHEN x.id IS NULL THEN 'ambiguous' ELSE ['exact','normalized_url','video_id','external_id','basename'][x.i+1] END AS level, coalesce(x.cnt,0) AS candidates FROM go WHERE p>0"""


@add("JOI-06", _GREEDY)
def joi06(t):
    """Reconciliation of a catalog with files by five keys: the first key that settles a record decides, each file serves one record, an ambiguous match is not made."""
    left, right, keys = _catalog(t)
    return M.reconcile(left, right, "record", "id", "pos", keys)


@add("JOI-06-levels", _LEVELS)
def joi06_levels(t):
    """The same without the use of each file once: every record's first key that finds anything, by size or agency and release."""
    return _cascade(t)


@add("JOI-07", "SELECT DISTINCT 'event' AS side, event_id AS k FROM canonical_events WHERE event_id NOT IN (SELECT event_id FROM event_members WHERE event_id IS NOT NULL) UNION ALL SELECT DISTINCT 'member', event_id FROM event_members WHERE event_id NOT IN (SELECT event_id FROM canonical_events WHERE event_id IS NOT NULL)")
def joi07(t):
    """Events without members, and members without an event."""
    c, m = t("canonical_events").select("event_id").distinct(), t("event_members").filter("event_id is not null").select("event_id").distinct()
    side = lambda x, y, n: x.join(y, "event_id", "left_anti").select(F.lit(n).alias("side"), F.col("event_id").alias("k"))
    return side(c, m, "event").unionByName(side(m, c, "member"))


@add("JOI-08", "SELECT CASE WHEN o_orderkey%10=9 THEN o_orderkey+1000000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey%10=0 THEN 'modified' WHEN o_orderkey%10=9 THEN 'new' ELSE 'unchanged' END AS change FROM orders UNION ALL SELECT o_orderkey, 'deprecated' FROM orders WHERE o_orderkey%10=9")
def joi08(t):
    old = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    r = F.col("o_orderkey") % 10
    new = old.select(F.when(r == 9, F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus", F.when(r == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return R.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@add("JOI-09")
def joi09(t):
    """Pairs of entities of one kind with alike names, checked against brute force in the tests."""
    return M.similar_in_group(t("entities"), "id", ["kind"], "name", 0.8, 8)


_TOK = "SELECT DISTINCT event_id AS id, unnest(list_distinct(regexp_extract_all(lower(label),'[a-z0-9]+'))) AS t FROM canonical_events WHERE label IS NOT NULL"


def _labels(t):
    return t("canonical_events").filter("label is not null").select("event_id", "label", "occurred_at").distinct()


@add("JOI-10", f"WITH k AS ({_TOK}) SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.t=y.t AND x.id<y.id WHERE length(x.t)>=2 GROUP BY ALL HAVING count(*)>=2")
def joi10(t):
    e = _labels(t).select("event_id", "label").distinct()
    return M.token_pairs(e, e, "event_id", "label", 2).filter("a < b")


@add("JOI-11", r"""WITH c AS (SELECT DISTINCT event_id, label, notes FROM canonical_events), k AS (SELECT event_id AS id, coalesce(regexp_extract(label,'((?:19|20)\d{2})',1),'') AS y, unnest(list_distinct(regexp_extract_all(label,'\b[A-Z][a-zA-Z]{3,}\b'))) AS t FROM c)
SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.t=b.t AND a.id<b.id AND (a.y=b.y OR a.y='' OR b.y='') GROUP BY ALL HAVING bool_or(a.y<>'' OR b.y<>'') OR max(length(a.t))>=8""")
def joi11(t):
    k = t("canonical_events").select("event_id", "label").distinct().select(F.col("event_id").alias("id"), F.coalesce(T.year_in("label"), F.lit("")).alias("y"), F.explode(T.capital_tokens("label")).alias("t"))
    return M.same_event_pairs(k)


@add("JOI-12")
def joi12(t):
    """Alike titles of records of different providers; checked against brute force in the tests."""
    return M.similar_across(t("source_records").filter("title is not null"), "identity_key", "provider", "title", 0.92, 12)


NEAREST = "SELECT id, other, score, CASE WHEN score>=0.8 THEN 'likely_duplicate' WHEN score>=0.6 THEN 'uncertain' ELSE 'new' END AS verdict FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON b.vec_id<>a.vec_id WHERE a.vec_id%100=0) WHERE n=1"


def nearest_rows(t):
    """For every hundredth row the nearest of all others and what that says: likely_duplicate, uncertain or new."""
    from evidex.operators.retrieval import nearest

    e = t("embeddings")
    b = nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 1, exclude_self=True)
    return b.select(F.col("vec_id").alias("id"), "other", F.col("similarity").alias("score"), M.ladder([("likely_duplicate", F.col("similarity") >= 0.8), ("uncertain", F.col("similarity") >= 0.6)], "new").alias("verdict"))


@add("JOI-13", NEAREST)
def joi13(t):
    return nearest_rows(t)


@add("JOI-14", "SELECT p_partkey, tok, n FROM (SELECT p_partkey, unnest(string_split(lower(p_type),' ')) AS tok FROM part) JOIN (SELECT tok, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type),' ')) AS tok FROM part) GROUP BY tok) USING (tok) WHERE tok<>''")
def joi14(t):
    k = t("part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("tok")).filter("tok <> ''")
    return k.join(k.groupBy("tok").agg(F.count(F.lit(1)).alias("n")), "tok").select("p_partkey", "tok", "n")


@add("JOI-15", r"""WITH c AS (SELECT DISTINCT event_id, split_part(label,' / ',1) AS place FROM canonical_events), s AS (SELECT DISTINCT id, ocr_text FROM source_files WHERE lower(trim(file_type))='webpage' AND ocr_text IS NOT NULL),
w AS (SELECT id, t, count(*) AS n, min(pos) AS p FROM (SELECT id, unnest(regexp_extract_all(ocr_text,'[A-Z][a-z]+')) AS t, 0 AS pos FROM s) GROUP BY ALL)
SELECT id, event_id, n>=2 OR contains(substr(ocr_text,1,800),place) AS prime FROM c JOIN w ON w.t=c.place JOIN s USING (id)""")
def joi15(t):
    """Places of events in analysis texts; prime if named in the lead or twice."""
    c = t("canonical_events").select("event_id", F.split("label", " / ")[0].alias("place")).distinct()
    s = t("source_files").filter("lower(trim(file_type)) = 'webpage' and ocr_text is not null").select("id", "ocr_text").distinct()
    w = s.select("id", F.substring("ocr_text", 1, 800).alias("lead"), F.explode(F.regexp_extract_all("ocr_text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("place")).groupBy("id", "lead", "place").agg(F.count(F.lit(1)).alias("n"))
    return w.join(c, "place").select("id", "event_id", ((F.col("n") >= 2) | F.col("lead").contains(F.col("place"))).alias("prime"))


@add("JOI-16", "SELECT DISTINCT event_id, source_filename, CASE WHEN role='media' THEN 'media' ELSE 'extract' END AS rel FROM event_members m WHERE source_filename IS NOT NULL AND event_id IN (SELECT event_id FROM event_members WHERE role='observation')")
def joi16(t):
    m = t("event_members")
    seen = m.filter("role = 'observation'").select("event_id")
    return m.filter("source_filename is not null").join(seen, "event_id", "left_semi").select("event_id", "source_filename", F.when(F.col("role") == "media", "media").otherwise("extract").alias("rel")).dropDuplicates()


@add("JOI-17", f"WITH k AS ({_TOK}), s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.t=y.t AND x.id<>y.id WHERE length(x.t)>=2 GROUP BY ALL HAVING count(*)>=2) SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS n FROM s) WHERE n=1")
def joi17(t):
    e = _labels(t).select("event_id", "label").distinct()
    best = M.token_pairs(e, e, "event_id", "label", 2).filter("a <> b").groupBy("a").agg(F.min(F.struct((-F.col("shared")).alias("s"), "b")).alias("x"))
    return best.select("a", "x.b", (-F.col("x.s")).alias("shared"))


@add("JOI-18", f"WITH k AS (SELECT k.*, year(c.occurred_at)//10 AS y FROM ({_TOK}) k JOIN (SELECT DISTINCT event_id, occurred_at FROM canonical_events WHERE occurred_at IS NOT NULL) c ON c.event_id=k.id), s AS (SELECT x.id AS a, y.id AS b, count(DISTINCT x.t) AS shared FROM k x JOIN k y ON x.t=y.t AND x.y=y.y AND x.id<>y.id WHERE length(x.t)>=5 GROUP BY ALL) SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS n FROM s) WHERE n=1")
def joi18(t):
    """Best partner of the same decade by shared words: the decade guards the match."""
    y = t("canonical_events").filter("occurred_at is not null").select("event_id", F.floor(F.year("occurred_at") / 10).alias("y")).distinct()
    k = t("canonical_events").filter("label is not null").select("event_id", F.explode(T.tokens("label", 5)).alias("t")).distinct().join(y, "event_id")
    s = k.toDF("a", "t", "y").join(k.toDF("b", "t", "y"), ["y", "t"]).filter("a <> b").groupBy("a", "b").agg(F.count_distinct("t").alias("shared"))
    return s.groupBy("a").agg(F.min(F.struct((-F.col("shared")).alias("s"), "b")).alias("x")).select("a", "x.b", (-F.col("x.s")).alias("shared"))


@add("JOI-19", "SELECT k, region, score FROM (SELECT case_id AS k, region, length(region) AS score, row_number() OVER (PARTITION BY case_id ORDER BY length(region) DESC, region) AS n FROM (SELECT DISTINCT case_id, lower(location_text) AS place FROM incidents WHERE location_text IS NOT NULL) i JOIN (SELECT DISTINCT region FROM region_zones) r ON contains(place, lower(region))) WHERE n=1")
def joi19(t):
    """Containment scores by the length of the name found: the regions are a fixed list of names, looked for as words of a pattern."""
    names = [r[0] for r in fixed_rows(t("region_zones").select("region").distinct(), 1000)]
    p = t("incidents").filter("location_text is not null").select(F.col("case_id").alias("k"), F.lower("location_text").alias("place")).distinct()
    hits = F.filter(F.array(*(F.struct(F.lit(len(n)).alias("score"), F.lit(n).alias("region"), F.lit(n.lower()).alias("low")) for n in names)), lambda x: F.col("place").contains(x["low"]))
    s = p.select("k", F.explode(hits).alias("x")).groupBy("k").agg(F.min(F.struct((-F.col("x.score")).alias("s"), "x.region")).alias("x"))
    return s.select("k", "x.region", (-F.col("x.s")).alias("score"))


@add("JOI-20", "SELECT id, level, agency FROM (SELECT f.id, r.agency, CASE WHEN f.byte_size=r.byte_size THEN 'size' ELSE 'agency' END AS level, row_number() OVER (PARTITION BY f.id ORDER BY CASE WHEN f.byte_size=r.byte_size THEN 0 ELSE 1 END, r.identity_key) AS n FROM (SELECT DISTINCT id, byte_size, agency, release_number FROM source_files) f JOIN (SELECT DISTINCT identity_key, byte_size, agency, release_number FROM source_records) r ON f.byte_size=r.byte_size OR (f.agency=r.agency AND f.release_number=r.release_number)) WHERE n=1")
def joi20(t):
    """The first record by size, else by agency and release; of the records of one key only the first can win, so one stands for all."""
    f, r = t("source_files").select("id", "byte_size", "agency", "release_number").distinct(), t("source_records").select("identity_key", "byte_size", "agency", "release_number").distinct()
    first = lambda *keys: r.groupBy(*keys).agg(F.min(F.struct("identity_key", F.col("agency").alias("found"))).alias("x"))
    a = f.join(first("byte_size"), "byte_size").select("id", F.lit(0).alias("p"), "x.*")
    b = f.join(first("agency", "release_number"), ["agency", "release_number"]).select("id", F.lit(1).alias("p"), "x.*")
    best = a.unionByName(b).groupBy("id").agg(F.min(F.struct("p", "identity_key", "found")).alias("x"))
    return best.select("id", F.when(F.col("x.p") == 0, "size").otherwise("agency").alias("level"), F.col("x.found").alias("agency"))


@add("JOI-21", r"""WITH k AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(string_split(trim(regexp_replace(lower(name),'[^a-z0-9]+',' ','g')),' ')) AS t FROM entities WHERE kind='program') WHERE length(t)>=3 AND t NOT IN ('project','program')), z AS (SELECT id, count(*) AS n FROM k GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(count(*)/greatest(any_value(x.n),any_value(y.n)),6) AS score FROM k a JOIN k b ON a.t=b.t AND a.id<b.id JOIN z x ON x.id=a.id JOIN z y ON y.id=b.id GROUP BY a.id, b.id HAVING count(*)/greatest(any_value(x.n),any_value(y.n))>=0.5""")
def joi21(t):
    toks = T.tokens("name", 3, ("project", "program"))
    k = t("entities").filter("kind = 'program'").select("id", F.size(toks).alias("n"), F.explode(toks).alias("t"))
    a, b = k.toDF("a", "na", "t"), k.toDF("b", "nb", "t")
    s = a.join(b, "t").filter("a < b").groupBy("a", "b").agg(F.round(F.count(F.lit(1)) / F.greatest(F.max("na"), F.max("nb")), 6).alias("score"))
    return s.filter("score >= 0.5")


@add("JOI-22", "SELECT m.event_id, m.case_id, f.media FROM (SELECT DISTINCT event_id, case_id FROM event_members) m LEFT JOIN (SELECT event_id, min(source_filename) AS media FROM event_members WHERE role='media' GROUP BY 1) f USING (event_id)")
def joi22(t):
    m = t("event_members")
    first = m.filter("role = 'media'").groupBy("event_id").agg(F.min("source_filename").alias("media"))
    return m.select("event_id", "case_id").distinct().join(first, "event_id", "left").select("event_id", "case_id", "media")


@add("JOI-23", "SELECT DISTINCT i.case_id, m.event_id, c.label FROM (SELECT DISTINCT case_id FROM incidents) i LEFT JOIN event_members m ON upper(trim(m.case_id))=upper(i.case_id) LEFT JOIN canonical_events c ON c.event_id=m.event_id")
def joi23(t):
    i = t("incidents").select("case_id").distinct().withColumn("k", F.upper("case_id"))
    m = t("event_members").select(F.upper(F.trim("case_id")).alias("k"), "event_id").distinct()
    c = t("canonical_events").select("event_id", "label").distinct()
    return i.join(m, "k", "left").join(c, "event_id", "left").select("case_id", "event_id", "label").distinct()


@add("JOI-24", "SELECT DISTINCT f.id, m.event_id FROM source_files f JOIN event_members m ON contains(upper(m.source_filename), upper(regexp_replace(f.filename,'\\.[a-z]*$','')))")
def joi24(t):
    """Events whose source names contain a file's stem: names of one stem share its number, which the join runs on."""
    key = lambda c: F.regexp_extract(c, r"(\d{8})", 1)
    f = t("source_files").select("id", F.upper(F.regexp_replace("filename", r"\.[a-z]*$", "")).alias("stem"), key(F.col("filename")).alias("k")).distinct()
    m = t("event_members").filter("source_filename is not null").select("event_id", F.upper("source_filename").alias("name"), key(F.col("source_filename")).alias("k")).distinct()
    return f.join(m, "k").filter(F.col("name").contains(F.col("stem"))).select("id", "event_id").distinct()


@add("JOI-25", "SELECT DISTINCT f.id, i.case_id FROM source_files f JOIN incidents i ON i.source_file_id=f.id WHERE lower(trim(f.file_type))='pdf'")
def joi25(t):
    f = t("source_files").filter("lower(trim(file_type)) = 'pdf'").select("id")
    return t("incidents").select(F.col("source_file_id").alias("id"), "case_id").distinct().join(f, "id", "left_semi").select("id", "case_id")


@add("JOI-26", "SELECT DISTINCT m.event_id, m.case_id, f.agency AS la, i.branch AS lb, f.agency IS NOT NULL AND i.branch IS NOT NULL AND f.agency<>i.branch AS crosses FROM event_members m LEFT JOIN (SELECT DISTINCT filename, agency FROM source_files) f ON f.filename=m.source_filename LEFT JOIN (SELECT DISTINCT case_id, branch FROM incidents) i ON i.case_id=upper(trim(m.case_id))")
def joi26(t):
    m = t("event_members").select("event_id", "case_id", F.col("source_filename").alias("filename")).distinct()
    f = t("source_files").select("filename", F.col("agency").alias("la")).distinct()
    i = t("incidents").select(F.col("case_id").alias("k"), F.col("branch").alias("lb")).distinct()
    j = m.join(f, "filename", "left").withColumn("k", F.upper(F.trim("case_id"))).join(i, "k", "left")
    return j.select("event_id", "case_id", "la", "lb", (F.col("la").isNotNull() & F.col("lb").isNotNull() & F.coalesce(F.col("la") != F.col("lb"), F.lit(False))).alias("crosses")).distinct()


@add("JOI-27", "SELECT DISTINCT s.identity_key, f.id, CASE lower(trim(f.file_type)) WHEN 'pdf' THEN 'document' WHEN 'video' THEN 'media' ELSE 'other' END AS hint FROM source_records s JOIN source_files f ON f.agency=s.agency AND f.release_number>s.release_number AND f.byte_size BETWEEN s.byte_size AND s.byte_size+5000")
def joi27(t):
    """Evidence of a later release for a record: an equi-join on agency and size class, then the comparison."""
    s = t("source_records").select("identity_key", "agency", F.col("release_number").alias("r"), "byte_size").distinct().withColumn("b", F.explode(F.array(F.floor(F.col("byte_size") / 5000), F.floor(F.col("byte_size") / 5000) + 1)))
    f = t("source_files").select("id", "agency", F.col("release_number").alias("r2"), F.col("byte_size").alias("size"), F.lower(F.trim("file_type")).alias("kind")).distinct().withColumn("b", F.floor(F.col("size") / 5000))
    j = s.join(f, ["agency", "b"]).filter("r2 > r and size between byte_size and byte_size + 5000")
    return j.select("identity_key", "id", T.lookup("kind", {"pdf": "document", "video": "media"}, F.lit("other")).alias("hint")).distinct()


@add("JOI-28", "SELECT DISTINCT a.case_id AS a, b.case_id AS b FROM incidents a JOIN incidents b ON a.occurred_at=b.occurred_at AND a.region=b.region AND a.case_id<b.case_id WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(a.location_text,'')),'[a-z]{6,}')), list_distinct(regexp_extract_all(lower(coalesce(b.location_text,'')),'[a-z]{6,}'))))>=2")
def joi28(t):
    """Incidents of one day and region whose places share two words: they meet under a shared word, not as a whole day."""
    i = t("incidents").filter("occurred_at is not null and region is not null").select("case_id", "occurred_at", "region", T.tokens("location_text", 6, pattern="[a-z]{6,}").alias("toks")).distinct()
    w = i.select("case_id", "occurred_at", "region", F.explode("toks").alias("t")).distinct()
    a, b = w.withColumnRenamed("case_id", "a"), w.withColumnRenamed("case_id", "b")
    pairs = a.join(b, ["occurred_at", "region", "t"]).filter("a < b")
    # two rows of a case may have different places: the words must be shared by one row of each
    few = pairs.groupBy("a", "b").agg(F.count_distinct("t").alias("n")).filter("n >= 2").select("a", "b")
    x, y = i.select(F.col("case_id").alias("a"), "occurred_at", "region", "toks"), i.select(F.col("case_id").alias("b"), "occurred_at", "region", F.col("toks").alias("toks2"))
    return few.join(x, "a").join(y, ["b", "occurred_at", "region"]).filter(F.size(F.array_intersect("toks", "toks2")) >= 2).select("a", "b").distinct()


@add("JOI-29", r"""WITH p AS (SELECT DISTINCT event_id, lower(split_part(label,' / ',1)) AS place FROM canonical_events WHERE label IS NOT NULL), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z]{5,}'))) AS t FROM documents)
SELECT doc_id, place, event_id FROM (SELECT doc_id, place, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(place) DESC, place, event_id) AS n FROM d JOIN p ON p.place=d.t) WHERE n=1""")
def joi29(t):
    """The longest place of an event that a document names; of the events of one place only the first can win, so one stands for all."""
    p = t("canonical_events").filter("label is not null").select("event_id", F.lower(F.split("label", " / ")[0]).alias("place")).groupBy("place").agg(F.min("event_id").alias("event_id"))
    d = t("documents").select("doc_id", F.explode(T.tokens("text", 5, pattern="[a-z]{5,}")).alias("place"))
    return d.join(p, "place").groupBy("doc_id").agg(F.min(F.struct((-F.length("place")).alias("n"), "place", "event_id")).alias("x")).select("doc_id", "x.place", "x.event_id")


@add("JOI-30", "SELECT DISTINCT f.id, m.case_id FROM source_files f JOIN (SELECT source_file_id, min(case_id) AS case_id FROM incidents GROUP BY 1) m ON m.source_file_id=f.id")
def joi30(t):
    m = t("incidents").groupBy(F.col("source_file_id").alias("id")).agg(F.min("case_id").alias("case_id"))
    return t("source_files").select("id").distinct().join(m, "id").select("id", "case_id")


_DRIFT = "SELECT filename, CASE WHEN regexp_matches(substr(coalesce(t,''),1,8000),'{0}') THEN 'report' ELSE 'other' END AS class, CASE WHEN length(coalesce(t,''))>4000 THEN 'extract' ELSE 'source_only' END AS action FROM (SELECT filename, max(ocr_text) AS t FROM source_files WHERE filename IS NOT NULL GROUP BY 1)"


@add("JOI-31", f"SELECT filename, a.class AS old_class, b.class AS new_class, a.action AS old_action, b.action AS new_action FROM ({_DRIFT.format('(?i)hovered|circled')}) a JOIN ({_DRIFT.format('(?i)hovered|circled|climbed').replace('>4000', '>5000')}) b USING (filename) WHERE a.class<>b.class OR a.action<>b.action")
def joi31(t):
    """Files whose class or action differ between two runs of the classifier, here with two rule sets and limits."""
    f = t("source_files").filter("filename is not null").groupBy("filename").agg(F.max("ocr_text").alias("ocr_text"))

    def run(rule, most, n):
        c = D.classify(f, "ocr_text", [("report", "high", rule)])
        return c.select("filename", F.col("document_class").alias(f"{n}_class"), F.when(F.length(F.coalesce("ocr_text", F.lit(""))) > most, "extract").otherwise("source_only").alias(f"{n}_action"))

    j = run("(?i)hovered|circled", 4000, "old").join(run("(?i)hovered|circled|climbed", 5000, "new"), "filename")
    return j.filter("old_class <> new_class or old_action <> new_action").select("filename", "old_class", "new_class", "old_action", "new_action")


@add("JOI-32", "SELECT case_id, coalesce(f.filename, 'local') AS origin FROM (SELECT DISTINCT case_id, source_file_id FROM incidents WHERE case_id LIKE 'UNDT-%') LEFT JOIN (SELECT DISTINCT id, filename FROM source_files) f ON f.id=source_file_id")
def joi32(t):
    i = t("incidents").filter(F.col("case_id").startswith("UNDT-")).select("case_id", F.col("source_file_id").alias("id")).distinct()
    return i.join(t("source_files").select("id", "filename").distinct(), "id", "left").select("case_id", F.coalesce("filename", F.lit("local")).alias("origin"))


@add("JOI-33", "SELECT DISTINCT i.case_id, i.extracted_at, coalesce(i.shape_description, f.file_type) AS filled FROM incidents i LEFT JOIN (SELECT id, max(trim(lower(file_type))) AS file_type FROM source_files GROUP BY 1) f ON f.id=i.source_file_id")
def joi33(t):
    f = t("source_files").groupBy(F.col("id").alias("source_file_id")).agg(F.max(F.trim(F.lower("file_type"))).alias("file_type"))
    return t("incidents").join(f, "source_file_id", "left").select("case_id", "extracted_at", F.coalesce("shape_description", "file_type").alias("filled")).distinct()


@add("JOI-34", "SELECT DISTINCT id, coalesce(nullif(url,''), filename) AS image, 0 AS p FROM source_files WHERE lower(trim(file_type))='image' UNION SELECT DISTINCT identity_key, original_url, 1 FROM source_records WHERE source_type='image'")
def joi34(t):
    a = t("source_files").filter("lower(trim(file_type)) = 'image'").select("id", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("filename")).alias("image"), F.lit(0).alias("p"))
    b = t("source_records").filter("source_type = 'image'").select(F.col("identity_key").alias("id"), F.col("original_url").alias("image"), F.lit(1).alias("p"))
    return a.unionByName(b).distinct()


@add("JOI-35", "SELECT DISTINCT 'file' AS which, id, release_number FROM source_files WHERE lower(trim(file_type))='video' UNION SELECT DISTINCT 'record', identity_key, release_number FROM source_records s WHERE source_type='video' AND NOT EXISTS (SELECT 1 FROM source_files f WHERE f.byte_size=s.byte_size)")
def joi35(t):
    a = t("source_files").filter("lower(trim(file_type)) = 'video'").select(F.lit("file").alias("which"), "id", "release_number")
    b = t("source_records").filter("source_type = 'video'").join(t("source_files").select("byte_size"), "byte_size", "left_anti").select(F.lit("record").alias("which"), F.col("identity_key").alias("id"), "release_number")
    return a.unionByName(b).distinct()


@add("JOI-36", "SELECT item_id, event_id FROM eval_items JOIN (SELECT DISTINCT event_id, split_part(label,' / ',1) AS place FROM canonical_events WHERE label IS NOT NULL) c ON contains(question, place) AND len(list_filter(regexp_extract_all(question,'[A-Z][a-z]{4,}'), lambda x: x=place))>0")
def joi36(t):
    """Events named in a question: the question's capitalised words are joined with the places, then containment is checked."""
    c = t("canonical_events").filter("label is not null").select("event_id", F.split("label", " / ")[0].alias("place")).distinct()
    q = t("eval_items").select("item_id", "question", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("place"))
    return q.join(c, "place").filter(F.col("question").contains(F.col("place"))).select("item_id", "event_id")
