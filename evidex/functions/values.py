"""Dates, numbers, arrays, maps, JSON and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.text import col, first_group, squeeze, strip


def us_short_date(c: Column | str) -> Column:
    """M/D/YY, M/D/YYYY or YYYY-MM-DD, the first that fits; two-digit years from 69 on are of the last century; else null."""
    s = squeeze(c)
    short = F.regexp_extract(s, r"^\d{1,2}/\d{1,2}/(\d{2})$", 1)
    year = F.when(short != "", F.when(short.cast("int") >= 69, 1900).otherwise(2000) + short.cast("int"))
    full = F.when(short != "", F.concat(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/)", 1), year.cast("string"))).otherwise(s)
    parts = F.split(full, "/")
    iso = F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"))
    return F.when(full.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(iso, "yyyy-MM-dd")).when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "y-M-d"))


def iso_date(c: Column | str) -> Column:
    """A date of the form YYYY-MM-DD; null for anything else or an impossible one."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(c), "yyyy-MM-dd"))


# English month names.
MONTHS = "January February March April May June July August September October November December".split()


def dated_text(c: Column | str) -> tuple[Column, Column]:
    """(date, precision) of a date text by the first pattern that fits: 'D Month YYYY', 'Month D, YYYY' (also of a span, its first day), 'Month YYYY', 'YYYY'."""
    s = strip(c)
    names = "|".join(MONTHS)
    number = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m.lower()), F.lit(i))))
    m = F.try_element_at(number, F.lower(F.regexp_extract(s, rf"(?i)\b({names})\b", 1)))
    y = F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1)
    d = F.coalesce(first_group(s, rf"(?i)\b(\d{{1,2}}) (?:{names}) (?:19|20)\d{{2}}\b"), first_group(s, rf"(?i)\b(?:{names}) (\d{{1,2}})(?:-\d{{1,2}})?, (?:19|20)\d{{2}}\b"))
    month = s.rlike(rf"(?i)\b(?:{names}) (?:19|20)\d{{2}}\b")
    make = lambda a, b, e: F.try_to_date(F.concat_ws("-", a, F.lpad(b.cast("string"), 2, "0"), F.lpad(e.cast("string"), 2, "0")), "yyyy-MM-dd")
    day = F.when(d.isNotNull(), make(y, m, d)).when(month, make(y, m, F.lit(1))).when(y != "", make(y, F.lit(1), F.lit(1)))
    return day, F.when(day.isNotNull(), F.when(d.isNotNull(), "day").when(month, "month").otherwise("year"))


def government_date(c: Column | str, pivot: int = 2030) -> Column:
    """M/D/Y with the first day of a span; a two-digit year past the pivot is a century earlier; a bare year gives null."""
    s = strip(F.split(strip(c), r"\s*[-–]\s*(?=\d{1,2}/)")[0])
    y = F.regexp_extract(s, r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$", 1)
    year = F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(F.try_to_number(y, F.lit("9999")).cast("int"))
    year = F.when((F.length(y) == 2) & (year > pivot), year - 100).otherwise(year)
    p = F.split(s, "/")
    return F.when(y != "", F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(p[0], 2, "0"), F.lpad(F.try_element_at(p, F.lit(2)), 2, "0")), "yyyy-MM-dd"))


def question_years(c: Column | str) -> tuple[Column, Column]:
    """(first year, last year) that a question asks for: a decade such as 1950s or 50s (from 20 on of the last century), or a year."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    long = first_group(s, r"\b((?:19|20)\d)0'?s\b").cast("int") * 10
    short = first_group(s, r"(?<!\d)'?(\d)0'?s\b").cast("int") * 10
    decade = F.coalesce(long, F.when(short >= 20, short + 1900).otherwise(short + 2000))
    year = first_group(s, r"\b((?:19|20)\d{2})\b").cast("int")
    return F.coalesce(decade, year), F.coalesce(decade + 9, year)


# --- vectors ----------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pad(v: Column, width: int) -> Column:
    """A vector with zeros added up to a width; a longer one is an error."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(width) - F.size(v), F.lit(0)))
    return F.when(F.size(v) <= width, F.concat(v, zeros)).otherwise(F.raise_error(F.lit(f"vector longer than {width}")))


def largest(v: Column, first: int, count: int) -> Column:
    """Largest absolute value of a stretch of a vector."""
    return F.array_max(F.transform(F.slice(v, first, count), lambda x: F.abs(x.cast("double"))))


def completeness(parts: list[tuple[Column, int]], text: Column, per: int = 100, most: int = 3) -> Column:
    """Weights of the parts that are there, and a point for every `per` characters of the text up to `most`."""
    total = F.lit(0)
    for present, weight in parts:
        total = total + F.when(F.coalesce(present, F.lit(False)), weight).otherwise(0)
    return total + F.least(F.floor(F.length(F.coalesce(text, F.lit(""))) / per), F.lit(most))


def band(c: Column, high: float = 0.6, medium: float = 0.3) -> Column:
    """'high', 'medium' or 'low'; null stays null."""
    return F.when(c >= high, "high").when(c >= medium, "medium").when(c.isNotNull(), "low")


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON in name order, nulls kept: equal exactly where all columns are."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def sparse_map(columns: list[str]) -> Column:
    """A map of the columns that are neither null, '' nor false."""
    m = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & (v != "false"))


def keep_known(a: Column, known: list[str]) -> Column:
    """Elements of an array that are in a list, with repeats, in order; null gives none."""
    return F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isin(known))
