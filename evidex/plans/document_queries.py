"""Documents and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions import values as V
from evidex.operators import documents as D
from evidex.operators import evidence as E
from evidex.operators import relational as R
from evidex.plans.join_queries import NEAREST, nearest_rows
from evidex.plans.registry import Book

book = Book()
add = book.add

_Q = r"""WITH s AS (SELECT source_file_id, page_number, regexp_replace(regexp_replace(coalesce(text,''),'^\s+',''),'\s+$','') AS s FROM page_results),
m AS (SELECT *, length(s) AS n, greatest(length(s),1) AS per, len(regexp_extract_all(s,'[\x20-\x7E\s]')) AS pr, len(regexp_extract_all(s,'\p{L}')) AS al, len(regexp_extract_all(s,'[A-Za-z]{2,}')) AS wc,
length(s)-length(replace(s,chr(65533),'')) AS rep, length(s)-length(replace(s,chr(173),'')) AS soft, len(regexp_extract_all(s,'[^\x00-\x7F—–…°]|[\x00-\x08\x0B\x0C\x0E\x0F]')) AS odd,
greatest(len(regexp_extract_all(s,'\S+')),1) AS tok, len(list_filter(regexp_extract_all(s,'\S+'), lambda x: regexp_matches(x,'[A-Za-z][^A-Za-z\s]{1,}[A-Za-z]|[!~\\^`|]'))) AS g, len(regexp_extract_all(s,'\b[A-Za-z]{3,}\b')) AS cl FROM s)
SELECT source_file_id, page_number, n AS native_char_count, round(pr/per,3) AS printable_ratio, round(al/per,3) AS alpha_ratio, wc AS word_count, CASE WHEN r='good' THEN 'native_good' WHEN r='thin' THEN 'native_thin' ELSE 'needs_ocr' END AS category, r AS reason FROM (
SELECT *, CASE WHEN n=0 THEN 'empty' WHEN soft>=2 THEN 'soft_hyphens' WHEN rep>=2 OR odd/per>0.12 THEN 'mojibake' WHEN g/tok>=0.12 OR (g>=8 AND cl/tok<0.55) THEN 'garbled'
WHEN n>=120 AND round(pr/per,3)>=0.85 AND round(al/per,3)>=0.45 AND wc>=15 AND cl/tok>=0.45 AND g/tok<0.08 THEN 'good' WHEN n>=40 AND round(pr/per,3)>=0.7 AND wc>=5 THEN 'thin' ELSE 'below_thresholds' END AS r FROM m)"""


@add("DOC-01", _Q)
def doc01(t):
    return D.page_quality(t("page_results"), "text").select("source_file_id", "page_number", "native_char_count", "printable_ratio", "alpha_ratio", F.col("word_count"), "category", "reason")


@add("DOC-02", r"""SELECT id, page, length(body) AS chars FROM (SELECT id, CASE WHEN i>0 THEN regexp_extract(p,'^(\d+)',1)::INTEGER ELSE 1 END AS page,
regexp_replace(regexp_replace(CASE WHEN i>0 THEN regexp_replace(p,'^\d+ ---','') ELSE p END,'^\s+',''),'\s+$','') AS body, i, k FROM (SELECT id, unnest(l) AS p, unnest(range(len(l)))::INTEGER AS i, len(l) AS k FROM
(SELECT id, string_split_regex(replace(chr(10)||ocr_text, chr(10)||'--- PAGE ', chr(1)), chr(1)) AS l FROM source_files WHERE ocr_text IS NOT NULL))) WHERE i>0 OR (k=1 AND body<>'')""")
def doc02(t):
    return D.split_pages(t("source_files").select("id", "ocr_text"), "ocr_text").select("id", "page", F.length("body").alias("chars"))


_CUES = {"routing": r"(?i)\b(distribution list|index card)\b", "memo": r"(?i)\b(memorandum|covering note)\b", "observation": r"(?i)\b(hovered|circled|observed|caught a glimpse)\b", "press": r"(?i)\b(newspaper|magazine)\b", "date": r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", "place": r"(?i)\b(harbour|ridge)\b"}


@add("DOC-03", "WITH c AS (SELECT source_file_id, page_number, length(regexp_replace(regexp_replace(coalesce(text,''),'^\\s+',''),'\\s+$','')) AS n, " + ", ".join(f"len(regexp_extract_all(coalesce(text,''),'{p}')) AS {k}" for k, p in _CUES.items()) + """ FROM page_results)
SELECT source_file_id, page_number, CASE WHEN n<80 THEN 'skip_empty' WHEN routing>=1 AND observation+memo=0 THEN 'skip_routing' WHEN press>=1 AND memo=0 THEN 'skip_press' WHEN routing=0 AND press=0 AND n>=200 AND (memo>=1 OR (observation>=1 AND date>=1)) THEN 'narrative' ELSE 'uncertain' END AS route, round(least(1.0,(observation+memo)/3),3) AS cue, date+place AS cues FROM c""")
def doc03(t):
    return D.page_signals(t("page_results"), "text", _CUES).select("source_file_id", "page_number", "route", F.col("incident_cue_score").alias("cue"), F.col("date_location_cues").alias("cues"))


@add("DOC-04")
def doc04(t):
    """Chunks of at most 2,000 characters along paragraphs; the fold is tested against hand cases and a round trip."""
    d = t("documents").select("doc_id", F.posexplode(D.chunks(F.col("text"), 2000)).alias("chunk", "part"))
    return d.select("doc_id", "chunk", F.length("part").alias("chars"), F.sha1("part").alias("sha1"))


def _pages(t):
    return D.split_pages(t("source_files").filter("ocr_text is not null").select("id", "ocr_text").distinct(), "ocr_text")


@add("DOC-05")
def doc05(t):
    """Sections of pages that aren't empty, of at most 15,000 characters."""
    p = D.page_signals(_pages(t), "body", _CUES)
    g = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"), F.collect_set(F.when(F.col("route") != "skip_empty", F.col("page"))).alias("kept"))  # the pages of one text
    return D.sections(g, "id", "pages", "kept").select("id", "section", F.length("text").alias("chars"))


@add("DOC-06", r"""SELECT id, CASE WHEN pages>=15 AND chars>6000 AND routing>=3 AND narrative>=1 THEN 'cue_routed' ELSE 'fixed' END AS strategy FROM (SELECT source_file_id AS id, count(*) AS pages, sum(n) AS chars, count(*) FILTER (WHERE o=0 AND r>=1 AND n>=80) AS routing, count(*) FILTER (WHERE o>=1 AND r=0 AND n>=200) AS narrative FROM
(SELECT DISTINCT source_file_id, page_number, text, length(trim(text)) AS n, len(regexp_extract_all(text,'(?i)\b(distribution list|index card)\b')) AS r, len(regexp_extract_all(text,'(?i)\b(hovered|circled)\b')) AS o FROM page_results) GROUP BY 1)""")
def doc06(t):
    p = t("page_results").select("source_file_id", "page_number", "text").distinct()
    p = p.select(F.col("source_file_id").alias("id"), F.length(F.trim("text")).alias("n"), F.regexp_count("text", F.lit(r"(?i)\b(distribution list|index card)\b")).alias("r"), F.regexp_count("text", F.lit(r"(?i)\b(hovered|circled)\b")).alias("o"))
    g = p.groupBy("id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"), F.count_if((F.col("o") == 0) & (F.col("r") >= 1) & (F.col("n") >= 80)).alias("routing"), F.count_if((F.col("o") >= 1) & (F.col("r") == 0) & (F.col("n") >= 200)).alias("narrative"))
    return g.select("id", D.strategy(F.col("pages"), F.col("chars"), F.col("routing"), F.col("narrative"), 6000).alias("strategy"))


@add("DOC-07", "SELECT source_file_id AS id, (count(*)//2)::BIGINT AS first, (count(*)-count(*)//2)::BIGINT AS second FROM (SELECT DISTINCT source_file_id, page_number FROM page_results) GROUP BY 1 HAVING count(*)>=2")
def doc07(t):
    p = t("page_results").select("source_file_id", "page_number").distinct().groupBy(F.col("source_file_id").alias("id")).agg(F.sort_array(F.collect_list("page_number")).alias("pages")).filter(F.size("pages") >= 2)  # page numbers of one file
    a, b = D.halves(F.col("pages"))
    return p.select("id", F.size(a).cast("long").alias("first"), F.size(b).cast("long").alias("second"))


@add("DOC-08")
def doc08(t):
    """Sections halved until a stand-in model (that takes 3,000 characters) answers whole."""
    import pandas as pd

    def run(it):
        for pdf in it:
            rows = []
            for i, ps in zip(pdf["id"], pdf["pages"], strict=True):
                ask = lambda s: ("max_tokens", None) if len(s) > 3000 else ("end", [len(s)])
                got, count = D.subdivide([(p["page"], p["body"]) for p in ps], ask)
                rows.append((i, len(got), count["calls"], count["splits"], count["failures"]))
            yield pd.DataFrame(rows, columns=["id", "answers", "calls", "splits", "failures"])

    g = _pages(t).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))  # the pages of one text
    return g.mapInPandas(run, "id string, answers long, calls long, splits long, failures long")


_RULES = [("listing", "high", r"(?i)^\s*(finding aid|distribution list)"), ("transcript", "high", r"(?i)\b(tower|voice \d):"), ("radio", "medium", r"(?i)\bcontrol, \w+ control, this is\b"), ("correspondence", "medium", r"(?i)\b(dear (sir|madam)|sincerely)\b"), ("incident_report", "medium", r"(?i)\b(hovered|zigzagged|accelerated)\b")]


@add("DOC-09", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{c}'" for c, _, p in _RULES) + " ELSE 'other' END AS document_class, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{f}'" for _, f, p in _RULES) + " ELSE 'low' END AS confidence FROM (SELECT doc_id, substr(text,1,8000) AS t FROM documents)")
def doc09(t):
    return D.classify(t("documents"), "text", _RULES).select("doc_id", "document_class", "confidence")


_CALLED = "SELECT doc_id, t, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{c}'" for c, _, p in _RULES) + " ELSE 'other' END AS rule, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{f}'" for _, f, p in _RULES) + " ELSE 'low' END AS sure FROM (SELECT doc_id, substr(text,1,8000) AS t FROM documents)"


@add("DOC-10", f"SELECT doc_id, CASE WHEN sure='high' OR doc_id%5=0 THEN rule ELSE 'press' END AS document_class, CASE WHEN sure='high' THEN 'high' WHEN doc_id%5=0 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN sure='high' THEN 'rules' WHEN doc_id%5=0 THEN 'rules_after_invalid' ELSE 'model' END AS method FROM ({_CALLED})")
def doc10(t):
    """Rules where they are sure, else a model; a stand-in model answers 'press', and for every fifth document a class that doesn't exist, which is rejected."""
    answer = lambda ids, texts: ["nonsense" if i % 5 == 0 else "press" for i in ids]
    return D.classify_hybrid(t("documents"), "doc_id", "text", _RULES, answer, ["press", *(c for c, _, _ in _RULES), "other"])


_STAGE_A = f"""WITH q AS (SELECT DISTINCT * FROM ({_Q})), g AS (SELECT source_file_id, count(*) AS pages, count(*) FILTER (WHERE category='native_good') AS native_good, count(*) FILTER (WHERE category='native_thin') AS native_thin, count(*) FILTER (WHERE category='needs_ocr') AS needs_ocr, count(*) FILTER (WHERE native_char_count=0) AS empty FROM q GROUP BY 1),
c AS (SELECT id AS source_file_id, CASE """ + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{c}'" for c, _, p in _RULES) + " ELSE 'other' END AS document_class, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{f}'" for _, f, p in _RULES) + """ ELSE 'low' END AS confidence FROM (SELECT id, substr(max(ocr_text),1,8000) AS t FROM source_files WHERE ocr_text IS NOT NULL GROUP BY 1)),
j AS (SELECT g.*, coalesce(document_class,'other') AS document_class, coalesce(confidence,'low') AS confidence FROM g LEFT JOIN c USING (source_file_id))
SELECT *, CASE WHEN empty=pages THEN 'failed' WHEN needs_ocr*2>pages THEN 'ocr' WHEN document_class='incident_report' THEN 'extract' ELSE 'source_only' END AS action FROM j"""


@add("DOC-11", _STAGE_A)
def doc11(t):
    """Stage A by file: pages by quality, class by rules, and what follows from them."""
    p = t("page_results").select("source_file_id", "page_number", "text").distinct()
    f = t("source_files").filter("ocr_text is not null").dropDuplicates(["id"]).select(F.col("id").alias("source_file_id"), "ocr_text")
    return D.stage_a(p, f, "source_file_id", "text", "ocr_text", _RULES, {"incident_report"})


@add("DOC-12", f"SELECT id, CASE WHEN score>=0.6 THEN 'same_event_new_source' ELSE 'new_event' END AS status, CASE WHEN score>=0.6 THEN other END AS of FROM ({NEAREST})")
def doc12(t):
    """New events relabelled after the nearest row: at 0.6 and more it is the same event from a new source."""
    s = nearest_rows(t)
    same = F.col("score") >= 0.6
    return s.select("id", F.when(same, "same_event_new_source").otherwise("new_event").alias("status"), F.when(same, F.col("other")).alias("of"))


@add("DOC-13", "SELECT filename, document_class, CASE WHEN document_class IN ('incident_report','radio','transcript') THEN 'extract' ELSE 'source_only' END AS action, rank FROM (SELECT filename, CASE " + " ".join(f"WHEN regexp_matches(t,'{p}') THEN '{c}'" for c, _, p in _RULES) + " ELSE 'other' END AS document_class, row_number() OVER (ORDER BY chars DESC, filename) AS rank FROM (SELECT filename, substr(coalesce(max(ocr_text),''),1,8000) AS t, length(coalesce(max(ocr_text),'')) AS chars FROM source_files WHERE filename IS NOT NULL GROUP BY 1)) WHERE rank<=50")
def doc13(t):
    """A run over cached texts: the fifty longest files in order, with class and action."""
    f = t("source_files").filter("filename is not null").groupBy("filename").agg(F.max("ocr_text").alias("ocr_text"))
    first = f.select("filename", "ocr_text", F.length(F.coalesce("ocr_text", F.lit(""))).alias("chars")).orderBy(F.col("chars").desc(), "filename").limit(50)
    c = R.top_per(D.classify(first, "ocr_text", _RULES).withColumn("all", F.lit(1)), ["all"], [F.col("chars").desc(), "filename"], 50)  # fifty rows
    return c.select("filename", "document_class", F.when(F.col("document_class").isin("incident_report", "radio", "transcript"), "extract").otherwise("source_only").alias("action"), "rank")


@add("DOC-14", "SELECT source_file_id, CASE WHEN k=0 THEN 'source_only' WHEN chars>15000 THEN 'rerun' ELSE 'keep' END AS action, CASE WHEN k>0 AND chars>15000 THEN CASE WHEN pages>=8 THEN 'sections' ELSE 'pages' END END AS strategy FROM (SELECT source_file_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE regexp_matches(text,'(?i)\\b(hovered|circled)\\b')) AS k FROM (SELECT DISTINCT source_file_id, page_number, text FROM page_results WHERE text IS NOT NULL) GROUP BY 1)")
def doc14(t):
    """Files whose answers were cut short are run again with a forced strategy: by sections where they have many pages, else page by page."""
    p = t("page_results").filter("text is not null").select("source_file_id", "page_number", "text").distinct()
    k = p.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").rlike(r"(?i)\b(hovered|circled)\b")).alias("k"))
    again = (F.col("k") > 0) & (F.col("chars") > 15000)
    return k.select("source_file_id", F.when(F.col("k") == 0, "source_only").when(again, "rerun").otherwise("keep").alias("action"), F.when(again, F.when(F.col("pages") >= 8, "sections").otherwise("pages")).alias("strategy"))


# --- evidence ---------------------------------------------------------------------------------------------------------


def _quotes(t):
    """Excerpts of incidents, and passages of pages, beside the text of their file, which is taken once for each file."""
    i = t("incidents").select("case_id", "source_file_id", "title", "summary", "raw_excerpt").distinct()
    name = F.concat_ws(":", "source_file_id", F.col("page_number").cast("string"))
    p = t("page_results").filter("length(text) > 400").select(name.alias("case_id"), "source_file_id", F.col("final_category").alias("title"), F.lit("page").alias("summary"), F.substring("text", 101, 240).alias("raw_excerpt"))
    i = i.unionByName(p.distinct())
    f = t("source_files").filter("ocr_text is not null").select(F.col("id").alias("source_file_id"), "ocr_text").dropDuplicates(["source_file_id"])
    f = f.select("source_file_id", T.quote_form("ocr_text").alias("src"))
    return i.join(f, "source_file_id").withColumn("form", T.quote_form("raw_excerpt"))


def _form(c):
    return rf"""regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(coalesce({c},''),chr(173),''),'---\s*PAGE\s+\d+\s*---',' ','g'),'([A-Za-z])-\s+([A-Za-z])','\1\2','g'))),'\s+',' ','g'),'\s+([.,;:!?])','\1','g')"""


_GATE = f"""o AS (SELECT DISTINCT case_id, source_file_id, title, summary, raw_excerpt FROM incidents UNION ALL SELECT DISTINCT source_file_id||':'||page_number, source_file_id, final_category, 'page', substr(text,101,240) FROM page_results WHERE length(text)>400),
i AS (SELECT *, {_form('raw_excerpt')} AS e FROM o), f AS (SELECT id, {_form('max(ocr_text)')} AS s FROM source_files WHERE ocr_text IS NOT NULL GROUP BY 1),
q AS (SELECT i.*, s, length(trim(coalesce(raw_excerpt,'')))<20 AS short, contains(s,e) AS inside, list_distinct(list_filter(string_split(e,' '), lambda x: x<>'')) AS ws FROM i JOIN f ON f.id=source_file_id),
g AS (SELECT *, CASE WHEN short THEN 'short' WHEN NOT (inside OR (len(ws)>0 AND len(list_filter(range(0, length(s)-length(e), 100), lambda k: len(list_filter(ws, lambda x: contains(' '||substr(s,k+1,length(e)+200)||' ', ' '||x||' ')))>=0.9*len(ws)))>0)) THEN 'absent' WHEN trim(coalesce(title,''))='' OR trim(coalesce(summary,''))='' THEN 'incomplete' ELSE 'ok' END AS gate FROM q)"""


@add("EVD-01", f"WITH {_GATE} SELECT case_id, gate FROM g")
def evd01(t):
    """Quote gate of incidents against the text of their files: containment in SQL, the window rule in Arrow."""
    return E.quote_gate(_quotes(t), "raw_excerpt", "form", "src", ["title", "summary"]).select("case_id", "gate")


_SUFF = r"""CASE WHEN length(e)<80 THEN 'excerpt_too_short_for_claim' WHEN len(regexp_extract_all(e,'[A-Za-z0-9'']+'))<12 THEN 'excerpt_too_few_words' WHEN NOT regexp_matches(e,'(?i)\b(observ|sight|witness|report|appear|detect|radar|sensor|object|craft|phenomenon|fireball|light|unidentified|uap|ufo|aircraft|flew|hover|altitude|visual|contact)\w*\b') THEN 'excerpt_lacks_observation_language'
WHEN (contains(lower(e),'image from') AND length(e)<120) OR (regexp_matches(e,'(?i)\b(page \d+ of \d+|ucni)\b') AND length(e)<100) OR (contains(lower(coalesce(title,'')),'incident report') AND length(e)<100) THEN 'thin_media_caption' ELSE 'ok' END"""


@add("EVD-02", f"SELECT case_id, {_SUFF} AS verdict FROM (SELECT case_id, title, trim(coalesce(raw_excerpt,'')) AS e FROM incidents)")
def evd02(t):
    return t("incidents").select("case_id", E.sufficiency("raw_excerpt", "title").alias("verdict"))


@add("EVD-03", f"WITH {_GATE} SELECT case_id, CASE WHEN gate<>'ok' THEN 'quote_rejected' WHEN v<>'ok' THEN 'insufficient' ELSE 'accepted' END AS outcome, CASE WHEN gate<>'ok' THEN 'quote_validation_failed' WHEN v<>'ok' THEN v END AS reason FROM (SELECT case_id, gate, {_SUFF} AS v FROM (SELECT case_id, title, raw_excerpt, gate, trim(coalesce(raw_excerpt,'')) AS e FROM g))")
def evd03(t):
    """Accepted, quote rejected or insufficient, with the reason: the quote gate decides first."""
    g = E.quote_gate(_quotes(t), "raw_excerpt", "form", "src", ["title", "summary"])
    enough = E.sufficiency("raw_excerpt", "title")
    reason = F.when(F.col("gate") != "ok", "quote_validation_failed").when(enough != "ok", enough)
    return g.select("case_id", E.outcome(F.col("gate"), enough).alias("outcome"), reason.alias("reason"))


def _ordered(t):
    i = R.first_per(t("incidents"), ["case_id"], ["extracted_at"])
    score = V.completeness([(F.col("occurred_at").isNotNull(), 3), (~T.blank("location_text"), 2)], F.col("raw_excerpt")).cast("int")
    return i.select("case_id", "source_file_id", "occurred_at", "location_text", "raw_excerpt", score.alias("score"), F.xxhash64("case_id").alias("pos"))


@add("EVD-04")
def evd04(t):
    """Incidents without repeats of an earlier one of the same file: equal, alike, or rather alike with the same day and place."""
    same = [F.col("occurred_at"), F.lower(T.strip(F.coalesce("location_text", F.lit(""))))]
    return E.distinct_in_order(_ordered(t), "case_id", ["source_file_id"], "pos", "raw_excerpt", same=same).select("case_id")


@add("EVD-05")
def evd05(t):
    """Of alike incidents of a file the less complete one flagged."""
    return E.flag_in_order(_ordered(t), "case_id", ["source_file_id"], "pos", "raw_excerpt", "score").select("case_id", "flagged_duplicate")


@add("EVD-06", "SELECT DISTINCT case_id, coalesce(i.branch, f.agency) AS branch FROM incidents i LEFT JOIN (SELECT id, max(agency) AS agency FROM source_files GROUP BY 1) f ON f.id=i.source_file_id")
def evd06(t):
    f = t("source_files").groupBy(F.col("id").alias("source_file_id")).agg(F.max("agency").alias("branch"))
    return E.fill(t("incidents").select("case_id", "source_file_id", "branch"), f, "source_file_id", ["branch"]).select("case_id", "branch").distinct()


@add("EVD-07", "SELECT DISTINCT s.identity_key, coalesce(s.agency,a.agency) AS agency, coalesce(s.release_label,a.label) AS release_label FROM source_records s LEFT JOIN (SELECT release_number, min(agency) AS agency, min(release_label) AS label FROM source_records GROUP BY 1) a USING (release_number)")
def evd07(t):
    s = t("source_records")
    a = s.groupBy("release_number").agg(F.min("agency").alias("agency"), F.min("release_label").alias("release_label"))
    return E.fill(s.select("identity_key", "release_number", "agency", "release_label"), a, "release_number", ["agency", "release_label"]).select("identity_key", "agency", "release_label").distinct()


@add("EVD-08", "SELECT DISTINCT event_id, citation, CASE WHEN i.case_id IS NULL THEN 'unknown' WHEN i.r='insufficient_data' THEN 'excluded' WHEN i.r='identified' THEN 'source_only' ELSE 'valid' END AS verdict FROM (SELECT event_id, unnest(list_distinct(list_transform(list_filter(member_case_ids, lambda x: x IS NOT NULL), lambda x: upper(trim(x))))) AS citation FROM canonical_events) LEFT JOIN (SELECT case_id, min(resolution_status) AS r FROM incidents GROUP BY 1) i ON i.case_id=citation")
def evd08(t):
    from evidex.operators.retrieval import citation_check

    a = t("canonical_events").select("event_id", F.array_distinct(F.transform(F.array_compact("member_case_ids"), lambda x: F.upper(F.trim(x)))).alias("cited"))
    ok = t("incidents").groupBy("case_id").agg(F.min("resolution_status").alias("r")).select("case_id", F.when(F.col("r") == "insufficient_data", "excluded").when(F.col("r") == "identified", "source_only").otherwise("valid").alias("status"))
    return citation_check(a, "event_id", "cited", ok, "case_id", "status").distinct()


_ANSWER = "passage || ' [ITEM-' || item_id || '] [ITEM-' || (item_id % 7) || ']'"


def _or(c, words):
    return "(" + " OR ".join(f"contains({c},'{w}')" for w in words) + ")"


def _certain(c):
    """SQL: list of {lemma, word} of a lower-case text."""
    words = "[" + ",".join(f"{{lemma:'{v}',word:'{k}'}}" for k, v in E.CERTAIN.items()) + "]"
    neg = E.SENTENCE_NEGATION.replace("'", "''")
    return rf"flatten(list_transform(list_filter(string_split(regexp_replace({c},'([.!?])\s+','\1'||chr(1),'g'),chr(1)), lambda x: NOT regexp_matches(x,'{neg}') AND NOT regexp_matches(x,'\bonly\s+confirms?\b')), lambda x: list_filter({words}, lambda w: regexp_matches(x,'\b'||w.word||'\b'))))"


_SCORED = rf"""WITH a AS (SELECT item_id, lower({_ANSWER}) AS t, ['ITEM-'||item_id, 'ITEM-'||(item_id%7)] AS cited, CASE WHEN item_id%5=0 THEN [] WHEN item_id%3=0 THEN ['ITEM-'||(item_id%7)] ELSE ['ITEM-'||item_id,'ITEM-9'] END AS known,
 CASE WHEN category='fact_lookup' THEN ['ITEM-'||item_id] ELSE [] END AS must, category='abstain' AS ab, category='temporal' AS hedge, category='series' AS ser, category='cross_source' AS med, CASE WHEN item_id%2=0 THEN 3 END AS cnt, ['two tired','the log'] AS forb, lower(question) AS ev, ['the'] AS men FROM eval_items),
b AS (SELECT *, list_distinct(list_filter(cited, lambda x: NOT list_contains(known,x))) AS inv, list_filter(cited, lambda x: list_contains(known,x)) AS hit, (len(must)=0 OR len(list_intersect(known,must))>0) AS has,
 list_filter(forb, lambda x: contains(t,x) AND NOT regexp_matches(string_split(string_split(t,x)[1],'.')[-1], '{E.PHRASE_NEGATION.replace("'", "''")}')) AS uns, list_transform({_certain('ev')}, lambda x: x.lemma) AS lem, {_certain('t')} AS cert FROM a),
c AS (SELECT *, list_filter(cert, lambda x: NOT list_contains(lem, x.lemma)) AS inf, (((len(known)=0) OR (len(must)>0 AND NOT has)) AND NOT ab) OR (ser AND cnt IS NULL) AS failed,
 {_or('t', E.ABSTAINS)} OR regexp_matches(substr(t,1,500),'\b(no|none|nothing|not|does not|do not)\b') AS decl, {_or('t', E.HEDGES)} AS hed, {_or('t', E.ATTRIBUTES)} AS att FROM b),
d AS (SELECT *, CASE WHEN len(uns)>0 THEN 'UNSUPPORTED' WHEN len(inf)>0 THEN 'OVERSTATED' WHEN hedge AND att AND NOT hed THEN 'SUPPORTED_WITH_ACCEPTABLE_PARAPHRASE' ELSE 'SUPPORTED' END AS st FROM c)
SELECT item_id, failed AND NOT ab AS retrieval_failure, len(inv)::INTEGER AS fake_citations, len(inv)::INTEGER AS citations_outside_retrieval, len(uns)::INTEGER AS unsupported_claims, array_to_string(uns,'|') AS unsupported_examples, CASE WHEN ab THEN decl AND len(uns)=0 AND len(inv)=0 END AS abstention_correct,
 round(len(hit)/len(list_distinct(cited)),6) AS citation_precision, CASE WHEN failed THEN NULL WHEN len(must)>0 AND has THEN (len(list_intersect(hit,must))>0)::INTEGER::DOUBLE ELSE 1.0 END AS citation_recall,
 CASE WHEN ser OR med THEN (NOT ser OR ((cnt IS NULL OR contains(t,cnt::VARCHAR)) AND (contains(t,'series') OR contains(t,'separate')) AND NOT (regexp_matches(t,'\b(one|single|a)\s+(giant\s+)?(uap\s+)?event\b') AND NOT contains(t,'not') AND NOT contains(t,'series')))) AND (NOT med OR {_or('t', E.MEDIA_WITHIN)}) END AS canonical_correct,
 contains(t,'the') AS completeness, CASE WHEN NOT (failed AND NOT ab) THEN starts_with(st,'SUPPORTED') END AS grounded, CASE WHEN NOT (failed AND NOT ab) THEN st END AS evidence_status, len(inf)=0 AND (att OR NOT hedge) AS epistemic_fidelity, array_to_string(list_sort(list_distinct(list_transform(inf, lambda x: x.word))),'|') AS certainty_inflation,
 hed OR NOT hedge AS hedge_ok, array_to_string(list_sort(list_distinct(cited)),'|') AS cited, array_to_string(list_sort(inv),'|') AS invalid FROM d"""


@add("EVD-09", _SCORED)
def evd09(t):
    """All seventeen figures of answers made of the items' passages, against expectations that follow from the item."""
    e = t("eval_items")
    name = lambda x: F.concat(F.lit("ITEM-"), x.cast("string"))
    i, cat, none = F.col("item_id"), F.col("category"), F.array().cast("array<string>")
    e = e.withColumns({
        "answer": F.concat("passage", F.lit(" ["), name(i), F.lit("] ["), name(i % 7), F.lit("]")), "known": F.when(i % 5 == 0, none).when(i % 3 == 0, F.array(name(i % 7))).otherwise(F.array(name(i), F.lit("ITEM-9"))),
        "must": F.when(cat == "fact_lookup", F.array(name(i))).otherwise(none), "ab": cat == "abstain", "hedge": cat == "temporal", "ser": cat == "series", "med": cat == "cross_source", "cnt": F.when(i % 2 == 0, 3), "forb": F.array(F.lit("two tired"), F.lit("the log")), "men": F.array(F.lit("the")),
    })
    s = E.score_answers(e, "answer", "known", must_cite="must", must_abstain="ab", require_hedge="hedge", series="ser", media="med", series_count="cnt", forbidden="forb", evidence="question", must_mention="men")
    flat = lambda c: F.array_join(F.sort_array(c), "|").alias(c)
    return s.select(
        "item_id", "retrieval_failure", "fake_citations", "citations_outside_retrieval", "unsupported_claims", F.array_join("unsupported_examples", "|").alias("unsupported_examples"), "abstention_correct", F.round("citation_precision", 6).alias("citation_precision"),
        "citation_recall", "canonical_correct", "completeness", "grounded", "evidence_status", "epistemic_fidelity", flat("certainty_inflation"), "hedge_ok", flat("cited"), flat("invalid"),
    )


_WANTED = {"fact_lookup": 68, "temporal": 60, "series": 50, "abstain": 73, "other": 5}


@add("EVD-10", "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}',{v})" for k, v in _WANTED.items()) + f") AS w(category, w)), n AS (SELECT category, count(*) AS n FROM eval_items GROUP BY 1) SELECT 'total' AS breach, '' AS what, count(*) AS n FROM eval_items HAVING count(*)<>{sum(_WANTED.values())} UNION ALL SELECT 'category', coalesce(n.category,w.category), coalesce(n,0) FROM n FULL JOIN w ON n.category=w.category WHERE n IS DISTINCT FROM w UNION ALL SELECT 'duplicate_id', item_id::VARCHAR, count(*) FROM eval_items GROUP BY 2 HAVING count(*)>1 UNION ALL SELECT 'no_text', item_id::VARCHAR, 1 FROM eval_items WHERE trim(coalesce(question,''))=''")
def evd10(t):
    """Breaches of a contract that the set departs from."""
    return E.contract(t("eval_items"), "item_id", "category", "question", _WANTED)
