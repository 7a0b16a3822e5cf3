"""Per-document text quality: character, word and line statistics, and published fixed-threshold rules whose failures are the verdict.

Everything is a Catalyst expression over the one row: no shuffle, no Python. A text is flagged if it fails a rule, and the names
of all rules that it fails are its reasons. The rules and thresholds:

* of MassiveText (Rae et al. 2021, "Scaling Language Models", appendix A): mean word length from 3 to 10, at most 0.1 symbols a word, less than
  90 % of the lines bullets, at most 30 % of the lines ending in an ellipsis, 80 % of the words with a letter, two of eight stop words;
* for scanned pages, at least 0.45 of the characters letters and 0.85 printable (the page gate of DOC-01);
* lines of lists, tables, forms and junk are for the most part of the text (line_kind() tells their kinds).

Others of the published rules don't hold for scanned pages and are recorded as notes only: a least length (fragments of prose are prose) and lines
that end in punctuation (lines of print end anywhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common English words that running prose can't do without and labels rarely have.
COMMON_WORDS = (
    "the of and a an in to was that is for on by at with from as had not were which but or no his her they one been when while yet under near into after "
    "before because although unless until between all up out off over who be it has two then against without despite according same some"
).split()
# The stop words of which a text of the MassiveText rules holds two.
STOP_WORDS = "the be to of and that have with".split()
WORD = r"(?<![^\s(\"'])[A-Za-zÀ-ÿ'’-]{2,}(?=[.,;:!?)\"']*(?:\s|$))"
TOKEN = r"\S+"
SYMBOL = r"[^\p{L}\p{N}_\s.,;:!?'\"()-]"
MOJIBAKE = r"�|ï¿½|Ã.|â€.|Â."
BULLET = r"^\s*(?:[*•·▪◦‣–—o-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+\S"
LABEL = r"(?i)^\s*(?:TAB|ITEM|EXHIBIT|ENCL|ENCLOSURE|ANNEX|FIG|BOX|SERIAL|NO)\.?\s+\w{1,4}\s*[:.)-]"
FIELD = r"^\s*[A-Z][A-Za-z0-9 ./'()#&-]{0,34}:(?:\s.{0,50})?$"
BLANKS = r"\.{4,}|_{4,}|(?:\. ){4,}"
DELIMITED = r"(?:[;|\t][^;|\t]*){2,}"
COLUMNS = r"\S(?: {3,}|\t)\S.*(?: {2,}|\t)\S"
NUMBER = r"(?<!\S)[^\sA-Za-z]*\d[^\sA-Za-z]*(?!\S)"
MIXED = r"(?<!\S)\S*(?:\d[A-Za-z|]|[A-Za-z|]\d)\S*(?!\S)"
PAGE_NUMBER = r"(?i)^\s*[-–—(\[~* ]*(?:page|p\.?|sheet)?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?[-–—)\]~* ]*$"


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def _shape(line: Column) -> Column:
    """Of one line: itself, trimmed, and its numbers of tokens, common words and words; a struct, so that each is counted once."""
    low = F.split(F.lower(line), r"[^a-z0-9_]+")
    return F.struct(line.alias("line"), F.trim(line).alias("s"), _count(line, TOKEN).alias("n"), F.size(F.filter(low, lambda x: x.isin(COMMON_WORDS))).alias("common"), _count(line, WORD).alias("words"))


def line_kind(shape: Column) -> Column:
    """'junk', 'table', 'form', 'list', 'prose' or 'other' (short lines that tell nothing) for the _shape() of one line that is not blank."""
    line, s, n, common, words = (shape[x] for x in ("line", "s", "n", "common", "words"))
    field = s.rlike(FIELD) & (common < 3)
    item = s.rlike(LABEL) | (line.rlike(BULLET) & ~((n >= 10) & (common >= 3)))
    # none of the tests below can hold for such a line, so most lines of prose are spared them
    plain = (common >= 2) & (words >= 3) & (2 * words > n) & s.rlike(r"^[\x20-\x3a\x3c-\x5e\x60-\x7b\x7d\x7e]+$") & ~s.contains("....") & ~s.contains(". . . .") & ~item & ~field
    junk = (
        (_count(s, MOJIBAKE) >= 2)
        | ((_count(s, SYMBOL) >= 0.12 * F.length(s)) & ~s.startswith("|") & (words < 0.5 * n))
        | (s.rlike(r"(.)\1{4,}") & (words < 2))
        | ((n >= 4) & (_count(s, r"(?<!\S)[A-Za-z](?!\S)") >= 0.6 * n))
        | ((common < 2) & (words <= 0.3 * n) & (_count(s, MIXED) >= 0.4 * n))
        | ((common < 2) & (F.length(s) >= 12) & (_count(s, r"[aeiouyAEIOUYÀ-ÿ]") < 0.12 * _count(s, r"\p{L}")))
    )
    table = (
        (s.rlike(DELIMITED) & ((common <= 2) | (_count(s, r"\|") >= 2)))
        | (line.rlike(COLUMNS) & (common < 2))
        | ((n >= 2) & (_count(s, NUMBER) >= 0.5 * n))
    )
    return (
        F.when(plain, "prose").when(junk, "junk").when(table, "table").when(s.rlike(BLANKS), "form").when(item, "list").when(field, "form")
        .when(((common >= 1) & (words >= 3)) | (words >= 5), "prose").otherwise("other")
    )


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """df with statistics of its text column.

    char_count, printable_ratio, alpha_ratio, word_count (words of two letters and more), mean_word_length, symbol_ratio
    (symbols per word), common_share (common words per word), letter_share (tokens with a letter), stop_words (how many of eight),
    line_count (lines that are not blank), end_punctuation_share, bullet_share, ellipsis_share and line_kinds (counts by kind, without
    page numbers). Defined results: null, empty and blank texts have counts and shares of 0; columns of these names that
    df already has are replaced; other columns and repeated rows pass through.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator keeps its result from being computed again for every use
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?U)\S"))
    out = df.withColumn("__t", t).withColumn("__l", once(F.transform(lines, _shape)))
    low = F.split(F.lower("__t"), r"[^a-z0-9_]+")
    n = F.greatest(F.length("__t"), F.lit(1))
    add = lambda f: F.aggregate("__l", F.lit(0), lambda s, x: s + x[f])
    words = _count(F.col("__t"), r"[A-Za-zÀ-ÿ]{2,}")
    per_word, size = F.greatest(F.col("word_count"), F.lit(1)), F.greatest(F.col("line_count"), F.lit(1))
    share = lambda p: F.round(F.size(F.filter("__l", lambda x: x["line"].rlike(p))) / size, 3)
    out = out.withColumns({
        "char_count": F.length("__t"),
        "printable_ratio": F.round((F.length("__t") - F.length(F.regexp_replace("__t", r"[\x20-\x7e\s]+", ""))) / n, 3),
        "alpha_ratio": F.round((F.length("__t") - F.length(F.regexp_replace("__t", r"\p{L}+", ""))) / n, 3),
        "word_count": words,
        "line_count": F.size("__l"),
        "letter_share": F.round(_count(F.col("__t"), r"[^\sA-Za-z]*[A-Za-z]\S*") / F.greatest(add("n"), F.lit(1)), 3),
        "stop_words": F.size(F.array_intersect(low, F.array(*map(F.lit, STOP_WORDS)))),
    })
    letters = F.length("__t") - F.length(F.regexp_replace("__t", r"[A-Za-zÀ-ÿ]{2,}", ""))
    out = out.withColumns({
        "mean_word_length": F.round(letters / per_word, 2),
        "symbol_ratio": F.round(_count(F.col("__t"), SYMBOL) / per_word, 3),
        "common_share": F.round(add("common") / per_word, 3),
        "end_punctuation_share": share(r"[.!?][\"')\]]*\s*$"),
        "bullet_share": share(BULLET),
        "ellipsis_share": share(r"(?:\.\.\.|…)\s*$"),
        "__k": once(F.transform(F.filter("__l", lambda x: ~x["line"].rlike(PAGE_NUMBER)), line_kind)),
    })
    number = lambda kind: F.size(F.filter("__k", lambda y: y == kind))
    counts = F.create_map(*(x for k in ("prose", "list", "table", "form", "junk", "other") for x in (F.lit(k), number(k))))
    return out.withColumn("line_kinds", once(counts)).drop("__t", "__l", "__k")


def judge(stats: DataFrame, neutral_weight: float = 0.6, most_other: float = 0.5) -> DataFrame:
    """stats with failed_rules, body_share, notes and verdict.

    failed_rules: the rules of the module that the text fails, in their order. verdict: 'empty'; 'prose' where none fails; else
    the commonest kind of its lines among 'list', 'table', 'form' and 'junk' (ties go to the kind first named). body_share is the share of lines of such kinds (a
    line that tells nothing counts neutral_weight), and fails over most_other; three such lines are needed where
    there are no others. notes: rules that are only told.
    """
    k = F.col("line_kinds")
    bad = k["list"] + k["table"] + k["form"] + k["junk"]
    total = bad + k["prose"] + k["other"]
    share = F.round(F.when(total > 0, (bad + neutral_weight * k["other"]) / total).otherwise(0.0), 3)
    named = lambda rules: F.filter(F.array(*(F.when(c, n) for n, c in rules)), lambda x: x.isNotNull())
    rules = [
        ("mean_word_length", ~F.col("mean_word_length").between(3, 10)), ("symbols", F.col("symbol_ratio") > 0.1), ("bullets", F.col("bullet_share") >= 0.9), ("ellipses", F.col("ellipsis_share") > 0.3),
        ("words_with_letters", F.col("letter_share") < 0.8), ("stop_words", F.col("stop_words") < 2), ("letters", F.col("alpha_ratio") < 0.45), ("printable", F.col("printable_ratio") < 0.85),
        ("lines_of_other_kinds", (F.col("body_share") > most_other) & ((bad > 0) | (k["other"] >= 3))),
    ]
    notes = [("few_words", F.col("word_count") < 50), ("end_punctuation", F.col("end_punctuation_share") < 0.12), ("common_words", F.col("common_share") < 0.1)]
    most = F.greatest(k["list"], k["table"], k["form"], k["junk"])
    kind = F.when(bad == 0, "list").when(k["list"] == most, "list").when(k["table"] == most, "table").when(k["form"] == most, "form").otherwise("junk")
    empty = F.col("char_count") == 0
    out = stats.withColumn("body_share", share).withColumn("failed_rules", F.when(empty, F.array().cast("array<string>")).otherwise(named(rules))).withColumn("notes", named(notes))
    return out.withColumn("verdict", F.when(empty, "empty").when(F.size("failed_rules") > 0, kind).otherwise("prose"))
