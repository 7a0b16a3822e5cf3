"""Scalar functions (text, dates, numbers, arrays, maps, JSON) over the archive's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions import values as V
from evidex.plans.registry import Book

book = Book()
add = book.add

# squeeze() in SQL
_SQ = "trim(regexp_replace(replace(replace(replace(replace(coalesce({0},''),'ﬁ','fi'),'ﬂ','fl'),chr(160),' '),chr(8239),' '),'\\s+',' ','g'))"


def sq(x: str) -> str:
    return _SQ.format(x)


@add("TXT-01", f"SELECT identity_key, {sq('title')} AS norm FROM source_records")
def txt01(t):
    return t("source_records").select("identity_key", T.squeeze("title").alias("norm"))


@add("TXT-02", f"SELECT identity_key, CASE WHEN s='' THEN 'untitled' ELSE s END AS slug FROM (SELECT identity_key, substr(regexp_replace(regexp_replace(lower({sq('title')}),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),1,80) AS s FROM source_records)")
def txt02(t):
    return t("source_records").select("identity_key", T.slug("title").alias("slug"))


@add("TXT-03", f"""SELECT identity_key, CASE WHEN {sq('external_id')}<>'' THEN provider||':'||upper({sq('external_id')}) ELSE provider||':h:'||substr(sha256(provider||'|'||lower({sq('title')})||'|'||{sq('original_url')}),1,24) END AS made
FROM source_records WHERE provider='pursue'""")
def txt03(t):
    return t("source_records").filter("provider = 'pursue'").select("identity_key", T.identity("pursue", "external_id", "title", "original_url").alias("made"))


@add("TXT-04", r"""SELECT identity_key, regexp_extract(u,'^([a-z][a-z0-9+.-]*)://',1)||'://'||regexp_extract(u,'^[a-z][a-z0-9+.-]*://([^/?#]*)',1)||
regexp_replace(regexp_extract(u,'^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)',1),'/+','/','g') AS url_key
FROM (SELECT identity_key, regexp_replace(lower(original_url),'/+$','') AS u FROM source_records WHERE original_url IS NOT NULL)""")
def txt04(t):
    return t("source_records").filter("original_url is not null").select("identity_key", T.url_key("original_url").alias("url_key"))


@add("TXT-05", r"""SELECT id, CASE WHEN s<>'' THEN s ELSE regexp_replace(lower(coalesce(filename,'')),'[^a-z0-9]+','','g') END AS base FROM (SELECT id, filename,
regexp_replace(lower(regexp_replace(regexp_extract(regexp_extract(coalesce(url,''),'^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)',1),'([^/]*)/?$',1),'(.)\.[^.]*$','\1')),'[^a-z0-9]+','','g') AS s FROM source_files)""")
def txt05(t):
    return t("source_files").select("id", T.base_key("url", "filename").alias("base"))


@add("TXT-06", r"SELECT identity_key, nullif(regexp_extract(original_url,'video(?:/embed)?/(\d+)',1,'i'),'') AS video FROM source_records")
def txt06(t):
    return t("source_records").select("identity_key", T.video_id(F.lit(None).cast("string"), "original_url").alias("video"))


@add("TXT-07", r"SELECT identity_key, upper(nullif(regexp_extract(coalesce(external_id,'')||' '||coalesce(original_url,''),'\b([A-Z]{2,6}-UAP-(?:D|PR)\d+[a-z]?)\b',1,'i'),'')) AS ext FROM source_records")
def txt07(t):
    return t("source_records").select("identity_key", T.external_id("external_id", "original_url").alias("ext"))


@add("TXT-08", r"SELECT identity_key, upper(nullif(regexp_extract(coalesce(external_id,''),'^\s*([A-Z]{2,6}-UAP-[A-Z]{0,2}\d+)',1,'i'),'')) AS prefix FROM source_records")
def txt08(t):
    return t("source_records").select("identity_key", T.id_prefix("external_id").alias("prefix"))


_AGENCY_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.AGENCIES.items())


@add("TXT-09", f"SELECT identity_key, nullif(CASE lower({sq('agency_raw')}) {_AGENCY_SQL} ELSE {sq('agency_raw')} END,'') AS agency FROM source_records")
def txt09(t):
    return t("source_records").select("identity_key", T.agency("agency_raw").alias("agency"))


@add("TXT-10", r"""SELECT case_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(coalesce(raw_excerpt,''),chr(173),''),'---\s*PAGE\s+\d+\s*---',' ','g'),'([A-Za-z])-\s+([A-Za-z])','\1\2','g'))),'\s+',' ','g'),'\s+([.,;:!?])','\1','g') AS quote FROM incidents""")
def txt10(t):
    return t("incidents").select("case_id", T.quote_form("raw_excerpt").alias("quote"))


@add("TXT-11")
def txt11(t):
    """Spaced-out letters of excerpts joined."""
    return t("incidents").select("case_id", T.quote_normal("raw_excerpt").alias("joined"))


@add("TXT-12", r"SELECT case_id, regexp_replace(lower(trim(coalesce(raw_excerpt,''))),'\s+',' ','g') AS norm FROM incidents")
def txt12(t):
    return t("incidents").select("case_id", T.fold_excerpt("raw_excerpt").alias("norm"))


@add("TXT-13")
def txt13(t):
    """Similarity of each incident's summary to its excerpt."""
    return t("incidents").select("case_id", F.round(T.ratio("summary", "raw_excerpt"), 6).alias("ratio"))


@add("TXT-14", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(name),'[a-z0-9]+'), lambda x: length(x)>=2 AND x NOT IN ('the','no','and')))),' ') AS tokens FROM entities")
def txt14(t):
    return t("entities").select("id", F.array_join(F.array_sort(T.tokens("name", 2, ("the", "no", "and"))), " ").alias("tokens"))


_STOP = ("the", "and", "for", "what", "which", "who", "was", "were", "that", "this", "with", "from", "did", "does", "there", "any", "how", "many")
_STOP_SQL = ",".join(f"'{w}'" for w in _STOP)


@add("TXT-15", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(question),'[a-z0-9]+'), lambda x: length(x)>2 AND x NOT IN ({_STOP_SQL})))),' ') AS tokens FROM eval_items")
def txt15(t):
    return t("eval_items").select("item_id", F.array_join(F.array_sort(T.tokens("question", 3, _STOP)), " ").alias("tokens"))


_PLACES = ["marrow plains", "kest gulf", "westermark", "hollin coast", "selmar basin"]
_PLACE_RE = r"\b(marrow\s+plains|kest\s+gulf|westermark|hollin\s+coast|selmar\s+basin)\b"


@add("TXT-16", rf"""SELECT case_id, array_to_string(list_sort(list_distinct(list_concat(f, list_filter(list_transform(f, lambda x: split_part(x,' ',1)), lambda x: length(x)>=5)))),'|') AS places
FROM (SELECT case_id, list_transform(regexp_extract_all(coalesce(location_text,''),'(?i){_PLACE_RE}',1), lambda x: lower(x)) AS f FROM incidents)""")
def txt16(t):
    return t("incidents").select("case_id", F.array_join(T.place_tokens("location_text", _PLACES), "|").alias("places"))


_GEN_SQL = ",".join(f"'{w}'" for w in dict.fromkeys(T.GENERIC_PLACE + T.GENERIC_TOPIC + T.GENERIC_OTHER))


@add("TXT-17", f"SELECT case_id, len(list_filter(regexp_extract_all(lower(coalesce(location_text,'')),'[a-z]+'), lambda x: x NOT IN ({_GEN_SQL})))=0 AS generic FROM incidents")
def txt17(t):
    return t("incidents").select("case_id", T.generic_place("location_text").alias("generic"))


@add("TXT-18", r"SELECT case_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(summary,''),'\b[A-Z][a-zA-Z]{3,}\b'), lambda x: x NOT IN ('Captain','Miss','Major')))),' ') AS names FROM incidents")
def txt18(t):
    return t("incidents").select("case_id", F.array_join(F.array_sort(T.capital_tokens("summary", ("Captain", "Miss", "Major"))), " ").alias("names"))


_NEW, _SAME = r"(?i)\b(\d+ weeks|\d+ days)\b", r"(?i)\b(that same evening|hours later|within \d+)\b"


@add("TXT-19", rf"SELECT case_id, CASE WHEN regexp_matches(coalesce(raw_excerpt,''),'{_NEW}') THEN 'new_episode' WHEN regexp_matches(coalesce(raw_excerpt,''),'{_SAME}') THEN 'same_episode' END AS cue FROM incidents")
def txt19(t):
    return t("incidents").select("case_id", T.episode_cue("raw_excerpt", _NEW, _SAME).alias("cue"))


@add("TXT-20", r"SELECT identity_key, CASE WHEN regexp_matches(coalesce(title,''),'(?i)\brange\s+fouler\b') THEN 'range-fouler-series' END AS series FROM source_records")
def txt20(t):
    return t("source_records").select("identity_key", F.when(F.coalesce("title", F.lit("")).rlike(r"(?i)\brange\s+fouler\b"), "range-fouler-series").alias("series"))


@add("TXT-21", r"SELECT case_id, nullif(regexp_extract(coalesce(occurred_at_text,''),'((?:19|20)\d{2})',1),'') AS year FROM incidents")
def txt21(t):
    return t("incidents").select("case_id", T.year_in("occurred_at_text").alias("year"))


@add("TXT-22", """SELECT case_id, coalesce(strftime(occurred_at,'%Y'),'UNDATED')||'-'||substr(replace(upper(coalesce(nullif(branch,''),'GOV')),' ',''),1,10)||'-'||upper(substr(sha1(coalesce(raw_excerpt,'')),1,6)) AS code FROM incidents""")
def txt22(t):
    return t("incidents").select("case_id", T.case_code("occurred_at", "branch", F.lit(None).cast("string"), "raw_excerpt").alias("code"))


@add("TXT-23", """SELECT case_id, coalesce(strftime(occurred_at,'%Y'),'undated')||'-'||replace(lower(coalesce(nullif(branch,''),'gov')),' ','')||'-'||
CASE WHEN len(w)>0 THEN array_to_string(w[1:5],'-') ELSE 'untitled' END||'-'||substr(sha1(coalesce(raw_excerpt,title,'')),1,4) AS slug
FROM (SELECT *, regexp_extract_all(lower(coalesce(title,'untitled')),'[a-z0-9]+') AS w FROM incidents)""")
def txt23(t):
    return t("incidents").select("case_id", T.page_slug("occurred_at", "branch", "title", "raw_excerpt").alias("slug"))


@add("TXT-24", r"""SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(a,'\[([A-Za-z0-9][A-Za-z0-9._/-]{2,})\]',1), lambda x: upper(x)))),' '),'') AS ids
FROM (SELECT event_id, 'see '||coalesce(array_to_string(list_transform(member_case_ids, lambda x: '['||trim(x)||']'),' and '),'') AS a FROM canonical_events WHERE member_case_ids IS NOT NULL)""")
def txt24(t):
    answer = F.concat(F.lit("see "), F.array_join(F.transform("member_case_ids", lambda x: F.concat(F.lit("["), F.trim(x), F.lit("]"))), " and "))
    return t("canonical_events").filter("member_case_ids is not null").select("event_id", F.array_join(F.array_sort(T.citations(answer)), " ").alias("ids"))


@add("TXT-25", r"SELECT id, trim(regexp_replace(lower(regexp_replace(coalesce(filename,''),'\.[A-Za-z0-9]{1,5}$','')),'[^a-z0-9]+',' ','g')) AS name_key FROM source_files")
def txt25(t):
    return t("source_files").select("id", T.name_key("filename").alias("name_key"))


@add("TXT-26", r"""SELECT identity_key, array_to_string(list_transform(list_filter(list_transform(string_split_regex(f,'[|,]'), lambda x: trim(x)), lambda x: x<>'' AND (NOT contains(x,' ') OR contains(lower(x),'event'))),
lambda x: upper(regexp_replace(x,'^([A-Za-z]+-[A-Za-z]+)-(\d+)$','\1-D\2'))),'|') AS tokens
FROM (SELECT identity_key, coalesce(external_id,'FBI-UAP-024')||' | western event, two words,'||coalesce(agency,'') AS f FROM source_records)""")
def txt26(t):
    f = F.concat(F.coalesce("external_id", F.lit("FBI-UAP-024")), F.lit(" | western event, two words,"), F.coalesce("agency", F.lit("")))
    return t("source_records").select("identity_key", F.array_join(T.pairing_tokens(f), "|").alias("tokens"))


@add("TXT-27", "SELECT identity_key, CASE WHEN contains(title,' ') AND contains(lower(title),'range') AND contains(lower(title),'fouler') THEN 'joins' WHEN contains(title,' ') THEN 'caption' ELSE 'id' END AS decision FROM source_records WHERE title IS NOT NULL")
def txt27(t):
    low = F.lower("title")
    d = F.when(F.col("title").contains(" ") & low.contains("range") & low.contains("fouler"), "joins").when(F.col("title").contains(" "), "caption").otherwise("id")
    return t("source_records").filter("title is not null").select("identity_key", d.alias("decision"))


_COUNTRY_RULES = [("orbit", None), ("orvania", "Orvania"), ("sarrah", "Sarrah"), ("kelland", "Kelland"), ("tovai", "Tovai"), ("aurel", "Aurel"), ("ocean", None)]
_COUNTRY_SQL = " ".join(f"WHEN contains(l,'{k}') THEN " + (f"'{v}'" if v else "NULL") for k, v in _COUNTRY_RULES)


@add("TXT-28", f"SELECT case_id, CASE {_COUNTRY_SQL} END AS country FROM (SELECT case_id, lower(coalesce(location_text,'')) AS l FROM incidents)")
def txt28(t):
    return t("incidents").select("case_id", T.ordered_keyword("location_text", _COUNTRY_RULES).alias("country"))


_HINTS = [("nasa", "NASA"), ("fbi", "FBI"), ("cia", "CIA"), ("dos", "State"), ("doe", "DoE"), ("odni", "ODNI")]
_HINT_SQL = " ".join(f"WHEN contains(lower(filename),'{k}') THEN '{v}'" for k, v in _HINTS)


@add("TXT-29", f"SELECT id, CASE {_HINT_SQL} ELSE 'USG' END AS agency FROM source_files")
def txt29(t):
    return t("source_files").select("id", T.ordered_keyword("filename", _HINTS, "USG").alias("agency"))


@add("TXT-30", r"SELECT id, regexp_matches(lower(name),'^(project|proj\.?|op\.?)\s|\sprogram$|\(project\)') AS program FROM entities")
def txt30(t):
    return t("entities").select("id", F.lower("name").rlike(r"^(project|proj\.?|op\.?)\s|\sprogram$|\(project\)").alias("program"))


@add("TXT-31", r"SELECT item_id, CASE WHEN regexp_matches(question,'(?i)\b(sighting|report|case|archive|file|light|sheet|signed|unit)\b') THEN 'archive' WHEN regexp_matches(question,'(?i)\b(recipe|weather today|stock|joke)\b') THEN 'off_topic' WHEN regexp_matches(question,'(?i)^\s*(hi|hello|hey)\b') THEN 'greeting' ELSE 'archive' END AS guard FROM eval_items")
def txt31(t):
    q = F.col("question")
    g = F.when(q.rlike(r"(?i)\b(sighting|report|case|archive|file|light|sheet|signed|unit)\b"), "archive").when(q.rlike(r"(?i)\b(recipe|weather today|stock|joke)\b"), "off_topic").when(q.rlike(r"(?i)^\s*(hi|hello|hey)\b"), "greeting").otherwise("archive")
    return t("eval_items").select("item_id", g.alias("guard"))


@add("TXT-32", r"""SELECT item_id, len(list_filter(string_split_regex(regexp_replace(trim(passage),'([.!?])\s+','\1' || chr(1),'g'),chr(1)), lambda x: NOT regexp_matches(x,'(?i)\b(no|not|never|without|cannot|isn''t|wasn''t|neither|nor|denied)\b') AND regexp_matches(x,'(?i)\b(probably|likely|hovered|confirmed)\b')))>0 AS asserted FROM eval_items""")
def txt32(t):
    return t("eval_items").select("item_id", T.asserted("passage", r"(?i)\b(probably|likely|hovered|confirmed)\b").alias("asserted"))


@add("TXT-33", "SELECT event_id, json_extract(props,'$.k')::BIGINT AS k FROM events")
def txt33(t):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return t("events").select("event_id", F.get_json_object(T.strip_fence(fenced), "$.k").cast("long").alias("k"))


@add("TXT-34", r"SELECT item_id, trim(regexp_replace(regexp_replace(passage||' [ID-001] . Sources: a, b','(?s)\s*Sources:.*$',''),'\s*\[[A-Za-z0-9-]+\]','','g')) AS shown FROM eval_items")
def txt34(t):
    a = F.concat("passage", F.lit(" [ID-001] . Sources: a, b"))
    return t("eval_items").select("item_id", F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)\s*Sources:.*$", ""), r"\s*\[[A-Za-z0-9-]+\]", "")).alias("shown"))


@add("TXT-35", r"SELECT id, upper(regexp_extract(filename,'^([a-z]+)-',1)) AS prefix, regexp_replace(filename,'\.[^.]*$','') AS stem, replace(regexp_replace(filename,'\.[^.]*$',''),'-',' ') AS title FROM source_files")
def txt35(t):
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return t("source_files").select("id", F.upper(F.regexp_extract("filename", r"^([a-z]+)-", 1)).alias("prefix"), stem.alias("stem"), F.replace(stem, F.lit("-"), F.lit(" ")).alias("title"))


@add("TXT-36", r"SELECT id, coalesce(nullif(regexp_extract(filename,'(\d{8})',1),''), nullif(lower(regexp_extract(filename,'-([a-z]+)-',1)),'')) AS ident FROM source_files")
def txt36(t):
    return t("source_files").select("id", F.coalesce(T.first_group("filename", r"(\d{8})"), F.lower(T.first_group("filename", r"-([a-z]+)-"))).alias("ident"))


@add("TXT-37", "SELECT id, CASE lower(trim(file_type)) WHEN 'pdf' THEN 'application/pdf' WHEN 'image' THEN 'image/jpeg' WHEN 'video' THEN 'video/mp4' WHEN 'audio' THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime FROM source_files")
def txt37(t):
    none = F.lit(None).cast("string")
    return t("source_files").select("id", T.mime_of(none, none.cast("binary"), F.lower(F.trim("file_type"))).alias("mime"))


# --- dates ------------------------------------------------------------------------------------------------------------


@add("DAT-01", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def dat01(t):
    o = t("orders")
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "M/d/yy"))
    return o.select("o_orderkey", V.us_short_date(text).alias("day"))


@add("DAT-02", "SELECT identity_key, CASE release_date WHEN DATE '2026-05-27' THEN 2 WHEN DATE '2026-07-04' THEN 4 WHEN DATE '2026-09-18' THEN 8 END AS release FROM source_records")
def dat02(t):
    table = {"5/27/26": "2", "7/4/26": "4", "9/18/26": "8"}
    return t("source_records").select("identity_key", T.lookup(F.date_format("release_date", "M/d/yy"), table).cast("int").alias("release"))


@add("DAT-03", r"""WITH m(n,i) AS (VALUES ('january',1),('february',2),('march',3),('april',4),('may',5),('june',6),('july',7),('august',8),('september',9),('october',10),('november',11),('december',12)),
x AS (SELECT case_id, trim(occurred_at_text) AS s FROM incidents WHERE regexp_matches(occurred_at_text,'^(\d{1,2} [A-Z][a-z]+ (19|20)\d\d|[A-Z][a-z]+ \d{1,2}, (19|20)\d\d|[A-Z][a-z]+ (19|20)\d\d)$')),
p AS (SELECT case_id, lower(regexp_extract(s,'([A-Z][a-z]+)',1)) AS mo, regexp_extract(s,'((?:19|20)\d\d)$',1) AS y, regexp_extract(s,'^(\d{1,2}) |[a-z] (\d{1,2}),',0) AS dd FROM x),
r AS (SELECT case_id, y, i, nullif(regexp_extract(dd,'(\d+)',1),'') AS d FROM p JOIN m ON n=mo)
SELECT case_id, try_cast(y||'-'||lpad(i::VARCHAR,2,'0')||'-'||lpad(coalesce(d,'1'),2,'0') AS DATE) AS day, CASE WHEN try_cast(y||'-'||lpad(i::VARCHAR,2,'0')||'-'||lpad(coalesce(d,'1'),2,'0') AS DATE) IS NOT NULL THEN CASE WHEN d IS NULL THEN 'month' ELSE 'day' END END AS precision FROM r""")
def dat03(t):
    full = r"^(\d{1,2} [A-Z][a-z]+ (19|20)\d\d|[A-Z][a-z]+ \d{1,2}, (19|20)\d\d|[A-Z][a-z]+ (19|20)\d\d)$"
    day, precision = V.dated_text("occurred_at_text")
    names = "|".join(V.MONTHS)
    return t("incidents").filter(F.col("occurred_at_text").rlike(full) & F.col("occurred_at_text").rlike(rf"\b({names})\b")).select("case_id", day.alias("day"), precision.alias("precision"))


@add("DAT-04", "SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def dat04(t):
    d = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" - 12/31/2030"))).otherwise(F.date_format(d, "M/d/yy"))
    return t("orders").select("o_orderkey", V.government_date(s).alias("day"))


@add("DAT-05", r"SELECT case_id, regexp_extract(occurred_at_text,'((?:19|20)\d{2})',1) AS year FROM incidents WHERE occurred_at IS NULL AND regexp_matches(occurred_at_text,'(?:19|20)\d{2}')")
def dat05(t):
    return t("incidents").filter("occurred_at is null").select("case_id", T.year_in("occurred_at_text").alias("year")).filter("year is not null")


@add("DAT-06", r"SELECT case_id, CASE WHEN regexp_matches(occurred_at_text,'^\d{4}-\d{2}-\d{2}$') THEN try_cast(occurred_at_text AS DATE) END AS day FROM incidents WHERE occurred_at_text <> '0000-00-00' OR occurred_at_text IS NULL")
def dat06(t):
    return t("incidents").filter("occurred_at_text <> '0000-00-00' or occurred_at_text is null").select("case_id", V.iso_date("occurred_at_text").alias("day"))


@add("DAT-07", r"""SELECT case_id, coalesce(d,y) AS first_year, coalesce(d+9,y) AS last_year FROM (SELECT case_id, try_cast(nullif(regexp_extract(lower(occurred_at_text),'\b((?:19|20)\d)0''?s\b',1),'') AS INTEGER)*10 AS d,
try_cast(nullif(regexp_extract(lower(occurred_at_text),'\b((?:19|20)\d{2})\b',1),'') AS INTEGER) AS y FROM incidents WHERE occurred_at_text IS NOT NULL)""")
def dat07(t):
    a, b = V.question_years("occurred_at_text")
    return t("incidents").filter("occurred_at_text is not null").select("case_id", a.alias("first_year"), b.alias("last_year"))


# --- numbers, arrays, maps, JSON --------------------------------------------------------------------------------------


@add("MTH-01", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def mth01(t):
    e = t("embeddings")
    a, b = e.select((F.col("vec_id") + 1).alias("k"), F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("k"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, "k").select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cos"))


@add("MTH-02", "SELECT vec_id, 128 AS width, round(sqrt(list_inner_product(embedding::DOUBLE[],embedding::DOUBLE[])),6) AS norm FROM embeddings")
def mth02(t):
    p = V.pad(F.col("embedding"), 128)
    return t("embeddings").select("vec_id", F.size(p).alias("width"), F.round(V.norm(p), 6).alias("norm"))


@add("MTH-03", """SELECT case_id, (CASE WHEN occurred_at IS NOT NULL THEN 3 ELSE 0 END)+(CASE WHEN coalesce(location_text,'')<>'' THEN 2 ELSE 0 END)+(CASE WHEN coalesce(branch,'')<>'' THEN 1 ELSE 0 END)+(CASE WHEN coalesce(len(sensor_types),0)>0 THEN 1 ELSE 0 END)
+least(floor(length(coalesce(raw_excerpt,''))/100)::BIGINT,3) AS score FROM incidents""")
def mth03(t):
    some = lambda c: ~T.blank(c)
    s = V.completeness([(F.col("occurred_at").isNotNull(), 3), (some("location_text"), 2), (some("branch"), 1), (F.size("sensor_types") > 0, 1)], F.col("raw_excerpt"))
    return t("incidents").select("case_id", s.cast("long").alias("score"))


@add("MTH-04", "SELECT source_file_id, page_number, CASE WHEN alpha_ratio>=0.6 THEN 'high' WHEN alpha_ratio>=0.3 THEN 'medium' WHEN alpha_ratio IS NOT NULL THEN 'low' END AS band FROM page_results")
def mth04(t):
    return t("page_results").select("source_file_id", "page_number", V.band(F.col("alpha_ratio")).alias("band"))


@add("MTH-06", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END)/count(*),6) AS prec, CASE WHEN sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END)>0 THEN round(sum(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 1 ELSE 0 END)/sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END),6) END AS rec FROM lineitem GROUP BY l_orderkey")
def mth06(t):
    hit, want = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.try_divide(F.count_if(hit), F.count(F.lit(1))), 6).alias("prec"), F.round(F.try_divide(F.count_if(hit & want), F.count_if(want)), 6).alias("rec"))


@add("MTH-07", "SELECT p_partkey, round(p_retailprice,1) AS r1, round(p_retailprice) AS r0 FROM part")
def mth07(t):
    """Rounding is half away from zero in both engines; halves that binary fractions hit exactly may differ elsewhere."""
    return t("part").select("p_partkey", F.round("p_retailprice", 1).alias("r1"), F.round("p_retailprice", 0).alias("r0"))


@add("ARR-01", "SELECT case_id, array_to_string(list_filter(coalesce(sensor_types,[]), lambda x: x IN ('radar','infrared','photo')),' ') AS known FROM incidents")
def arr01(t):
    return t("incidents").select("case_id", F.array_join(V.keep_known(F.col("sensor_types"), ["radar", "infrared", "photo"]), " ").alias("known"))


@add("ARR-02", "SELECT case_id, array_to_string(list_filter([CASE WHEN occurred_at IS NOT NULL THEN 'date' END, CASE WHEN location_text IS NOT NULL THEN 'place' END, CASE WHEN len(sensor_types)>0 THEN 'sensor' END], lambda x: x IS NOT NULL),' ') AS evidence FROM incidents")
def arr02(t):
    e = F.array_compact(F.array(F.when(F.col("occurred_at").isNotNull(), "date"), F.when(F.col("location_text").isNotNull(), "place"), F.when(F.size("sensor_types") > 0, "sensor")))
    return t("incidents").select("case_id", F.array_join(e, " ").alias("evidence"))


@add("MAP-01", "SELECT identity_key, (CASE WHEN coalesce(external_id,'')<>'' THEN 1 ELSE 0 END)+(CASE WHEN coalesce(description,'')<>'' THEN 1 ELSE 0 END)+(CASE WHEN coalesce(agency,'')<>'' THEN 1 ELSE 0 END) AS n, coalesce(agency,'-') AS agency FROM source_records")
def map01(t):
    m = V.sparse_map(["external_id", "description", "agency"])
    return t("source_records").select("identity_key", F.size(m).alias("n"), F.coalesce(F.try_element_at(m, F.lit("agency")), F.lit("-")).alias("agency"))


@add("JSN-01", "SELECT count(*) AS rows, count(DISTINCT (agency, byte_size, description, status, title)) AS kinds FROM source_records")
def jsn01(t):
    f = V.fingerprint(["title", "description", "agency", "status", "byte_size"])
    return t("source_records").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(f).alias("kinds"))


@add("JSN-02", "SELECT vec_id, round(embedding[1]::DOUBLE,5) AS first, len(embedding) AS n FROM embeddings")
def jsn02(t):
    back = F.from_json(F.to_json("embedding"), "array<double>")
    return t("embeddings").select("vec_id", F.round(back[0], 5).alias("first"), F.size(back).cast("long").alias("n"))
