"""Dates and times as people type them, brought to one unambiguous form.

Method: a text is cut into tokens, every token is replaced by a character class, and the resulting shape mask is looked
up. Each distinct mask is mapped to its parser (which token holds which field) once per worker; all texts of one mask
are then converted together with numpy, local times through transition tables of the tz database that carry their
version.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names and usual short forms in English, Spanish, French and German.
MONTHS = {
    1: "january jan enero janvier januar janv",
    2: "february feb febrero février fevrier februar févr fev",
    3: "march mar marzo mars märz maerz",
    4: "april apr abril avril avr",
    5: "may mayo mai",
    6: "june jun junio juin juni",
    7: "july jul julio juillet juli juil",
    8: "august aug agosto août aout",
    9: "september sep sept septiembre setiembre septembre",
    10: "october oct octubre octobre oktober okt",
    11: "november nov noviembre novembre",
    12: "december dec diciembre décembre decembre dezember dez",
}
# Roman numerals of months.
ROMAN = "i ii iii iv v vi vii viii ix x xi xii".split()
# Offsets in minutes of zone abbreviations.
ZONES = {
    "utc": 0, "gmt": 0, "zulu": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "gst": 240,
    "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Decades in words.
DECADES = {"thirties": 1930, "forties": 1940, "fifties": 1950, "sixties": 1960, "seventies": 1970, "eighties": 1980, "nineties": 1990}
MONTH_OF = {w: n for n, words in MONTHS.items() for w in words.split()}
FULL_MONTHS = {w: n for w, n in MONTH_OF.items() if len(w) >= 4}
#: Two-digit years run from here on for a century.
PIVOT = 1927


def military_offset(letter: str) -> int | None:
    """Minutes east of UTC of a military zone letter; None for J, and for L, which these reports use for local time."""
    letter = letter.upper()
    if letter in "JL":
        return None
    if letter == "Z":
        return 0
    if letter <= "I":
        return (ord(letter) - 64) * 60
    if letter <= "M":
        return (ord(letter) - 65) * 60
    return -(ord(letter) - 77) * 60


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone in minutes: offsets[i] holds for local time from local[i - 1] on (minutes since 1970).

    The table covers [first, last); civil times outside are asked of the tz database one by one.
    """

    zone: str
    version: str
    local: np.ndarray
    offsets: np.ndarray
    first: int
    last: int

    def to_utc(self, minutes: np.ndarray) -> np.ndarray:
        """Civil to UTC minutes. A repeated time is the earlier one; a skipped time moves forward by the gap."""
        out = minutes - self.offsets[np.searchsorted(self.local, minutes, side="right")]
        for i in np.flatnonzero((minutes < self.first + 1440) | (minutes >= self.last - 1440)):
            with suppress(OverflowError):  # years that no calendar of the database has keep the offset at the edge
                civil = datetime(1970, 1, 1) + timedelta(minutes=int(minutes[i]))
                out[i] = minutes[i] - round(civil.replace(tzinfo=ZoneInfo(self.zone)).utcoffset().total_seconds() / 60)
        return out


def tz_version() -> str:
    """Release of the installed tz database, or 'unknown'."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    for root in TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            p = Path(root, name)
            if p.exists():
                m = re.search(r"\b(20\d\d[a-z])\b", p.open(errors="replace").readline())
                if m:
                    return m[1]
    return "unknown"


@lru_cache(maxsize=None)
def zone_table(zone: str, first: int = 1926, last: int = 2028) -> ZoneTable | None:
    """Transition table of an IANA zone for the years from first to last, read day by day and refined to the minute; None for an unknown zone."""
    try:
        z = ZoneInfo(zone)
    except Exception:  # noqa: BLE001  (bad keys raise several kinds)
        return None
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def off(minute: int) -> int:
        return round((epoch + timedelta(minutes=minute)).astimezone(z).utcoffset().total_seconds() / 60)

    a = int((datetime(first, 1, 1, tzinfo=UTC) - epoch).total_seconds() // 60)
    b = int((datetime(last, 1, 1, tzinfo=UTC) - epoch).total_seconds() // 60)
    offs, local, prev = [off(a)], [], off(a)
    at, day, seen = epoch + timedelta(minutes=a), timedelta(days=1), None
    for m in range(a + 1440, b, 1440):
        at += day
        if (exact := at.astimezone(z).utcoffset()) == seen:
            continue
        seen, now = exact, off(m)
        if now != prev:
            lo, hi = m - 1440, m
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == prev else (lo, mid)
            local.append(hi + max(prev, now))
            offs.append(now)
            prev = now
    return ZoneTable(zone, tz_version(), np.array(local, dtype=np.int64), np.array(offs, dtype=np.int64), a, b)


# --- tokens and masks -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_MERIDIEM = re.compile(r"\b([ap])\s?\.\s?m\b\.?|\b([ap])m\b")
_ISO_T = re.compile(r"(?<=\d)t(?=\d\d?:)")
_ZULU = re.compile(r"(?<=:\d\d)z\b|(?<=\d\.\d{3})z\b|(?<=\d\.\d{6})z\b")
_NAMED = re.compile(r"\b[a-z]+/[a-z_]+(?:/[a-z_]+)?\b")
_DTG = re.compile(r"(\d\d)(\d\d)(\d\d)([a-z])(?:([a-z]{3})(\d{4}|\d\d))?")
_DIGIT_GLYPHS = str.maketrans("lio|", "1101")
_LETTER_GLYPHS = str.maketrans("1059", "losy")
_LEN_CODE = {1: "a", 2: "b", 3: "c", 4: "d", 6: "f", 8: "h", 10: "j", 13: "m"}
_WORD_CODE = {"hours": "H", "hour": "H", "hrs": "H", "hr": "H", "noon": "O", "midnight": "I", "local": "L", "l": "L", "day": "Y"}
_WORD_CODE |= {w: "Z" for w in ZONES}


def _edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@lru_cache(maxsize=65536)
def misread_month(word: str) -> int:
    """Month of a misread full month name (0: none): the first letter stands, at most two edits, no tie between months."""
    w = word.translate(_LETTER_GLYPHS)
    if w in MONTH_OF:
        return MONTH_OF[w]
    if len(w) < 4 or not w.isalpha():
        return 0
    found: dict[int, int] = {}
    for full, n in FULL_MONTHS.items():
        if full[0] == w[0] and (e := _edits(w, full, 2)) <= 2:
            found[n] = min(e, found.get(n, 9))
    if not found:
        return 0
    least = min(found.values())
    best = [n for n, e in found.items() if e == least]
    return best[0] if len(best) == 1 else 0


# Words that stand by dates and are no misread months.
_PLAIN = set("date note same night late early about circa sometime spring summer autumn winter above".split())


@lru_cache(maxsize=65536)
def _classify(tok: str) -> tuple[str, object]:
    """Class code and value of one token; code '' drops the token."""
    if tok.isdecimal():
        return _LEN_CODE.get(len(tok), "x"), int(tok) if len(tok) < 15 else 0
    if not tok[0].isalnum():
        return ("", None) if tok in ",()?[];\"" else (tok, None)
    if tok in _WORD_CODE:
        return _WORD_CODE[tok], tok
    if tok in MONTH_OF:
        return "M", MONTH_OF[tok]
    if tok in ROMAN:
        return "R", ROMAN.index(tok) + 1
    if tok in DECADES:
        return "K", DECADES[tok]
    if tok in ("pm", "am"):
        return "A", 12 * (tok == "pm")
    if m := re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)", tok):
        return "o", int(m[1])
    if re.fullmatch(r"\d{3}0s", tok):
        return "D", int(tok[:-1])
    if (m := _DTG.fullmatch(tok)) and (not m[5] or m[5] in MONTH_OF):
        return ("T" if not m[5] else "U"), m.groups()
    digits = tok.translate(_DIGIT_GLYPHS)
    if digits.isdecimal() and any(c.isdigit() for c in tok):
        return _LEN_CODE.get(len(digits), "x"), int(digits)
    if tok not in _PLAIN and (n := misread_month(tok)):
        return "M", n
    return "-w", tok


def tokenise(text: str) -> tuple[str, list]:
    """The shape mask of a text (one class code a token) and the values of the tokens."""
    s = text.strip().lower()
    named = _NAMED.search(s)
    zone = None
    if named:
        zone = "/".join("_".join(p.capitalize() for p in part.split("_")) for part in named[0].split("/"))
        s = s[: named.start()] + " " + s[named.end() :]
    s = _MERIDIEM.sub(lambda m: f" {m[1] or m[2]}m ", s)
    s = _ZULU.sub(" utc", _ISO_T.sub(" ", s))
    s = re.sub(r"(?<=\d0)['’]s\b", "s", s)
    mask, values, dropped = [], [], False
    for tok in _TOKEN.findall(s):
        code, value = _classify(tok)
        if code == "-w":
            dropped = True
        elif code == "" or (dropped and code in ".-'’"):
            pass
        else:
            mask.append(code)
            values.append(value)
            dropped = False
    if zone:
        mask.append("E")
        values.append(zone)
    return "".join(mask), values


# --- parsers: which token of a mask holds which field ------------------------------------------------------------------

_TZ = r"(?:(?P<z>Z)|(?P<s>[+-])(?:(?P<oh>b):(?P<om>b)|(?P<o4>d)))?"
_CLOCK = r"(?P<h>[ab]):(?P<n>b)(?::b(?:\.[a-z])?)?(?P<p>A)?"
_MIL = r"(?P<t4>d)H?"
_WHEN = rf"(?:(?:{_CLOCK}|{_MIL}){_TZ}L?E?)"
_DAY = r"(?P<d>[abo])"
_YEAR = r"(?P<y>d)"
_YEAR2 = r"(?P<y>d|b)"
#: (pattern over masks, precision); the first that fits a whole mask is its parser.
SHAPES = [
    (rf"{_YEAR}-(?P<m>b)-(?P<d>b){_WHEN}?", "day"),
    (rf"{_YEAR}/(?P<m>[ab])/(?P<d>[ab]){_WHEN}?", "day"),
    (rf"(?P<m>[ab])/(?P<d>[ab])/{_YEAR2}{_WHEN}?", "day"),
    (rf"(?P<d>[ab])\.(?P<m>[ab])\.{_YEAR2}(?:(?P<h>[ab])[.:](?P<n>b))?L?", "day"),
    (rf"{_DAY}[-.]?(?P<m>[MR])[-.]?{_YEAR2}{_WHEN}?", "day"),
    (rf"(?P<m>M)\.?{_DAY}{_YEAR}{_WHEN}?", "day"),
    (rf"{_WHEN}{_DAY}\.?(?P<m>[MR])\.?{_YEAR}E?", "day"),
    (rf"{_WHEN}(?P<m>M)\.?{_DAY}{_YEAR}E?", "day"),
    (rf"(?:(?P<noon>O)|(?P<midnight>I)){_DAY}\.?(?P<m>M)\.?{_YEAR}L?E?", "day"),
    (rf"(?:(?P<noon>O)|(?P<midnight>I))(?P<m>M)\.?{_DAY}{_YEAR}L?E?", "day"),
    (rf"{_DAY}-[abo](?P<m>M)\.?{_YEAR}", "day"),
    (rf"{_DAY}(?P<m>M)\.?-[abo]M\.?{_YEAR}", "day"),
    (rf"(?P<m>M)\.?{_DAY}-[abo]{_YEAR}", "day"),
    (rf"Y(?P<j>[abc]){_YEAR}", "ordinal"),
    (rf"{_YEAR}-(?P<j>c)", "ordinal"),
    (rf"{_YEAR}[-/](?P<m>b)", "month"),
    (rf"(?P<m>[ab])/{_YEAR}", "month"),
    (rf"(?P<m>[MR])[.-]?{_YEAR}Y?", "month"),
    (rf"{_YEAR}-?(?P<m>M)", "month"),
    (r"(?P<dec>[DK])", "decade"),
    (rf"{_YEAR}", "year"),
    (r"(?P<g>T)\.?(?P<m>M)\.?(?P<y>d|b)", "dtg"),
    (r"(?P<g>U)", "dtg"),
    (r"(?P<c8>h)", "compact"),
    (r"(?P<e>j)", "epoch_s"),
    (r"(?P<e>m)", "epoch_ms"),
]
_SHAPES = [(re.compile(p), kind) for p, kind in SHAPES]


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, dict[str, int]] | None:
    """Precision and index of the token of each field; None where no parser fits the mask."""
    for p, kind in _SHAPES:
        if m := p.fullmatch(mask):
            return kind, {k: m.start(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of valid dates."""
    return ((y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)).astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)
    return ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)


def _full_year(y: np.ndarray) -> np.ndarray:
    return np.where(y < 100, np.where(y + 1900 >= PIVOT, y + 1900, y + 2000), y)


def _convert(mask: str, rows: list[list], zones: list[str | None], tables: dict[str, ZoneTable]) -> list[str | None]:
    """Normal forms of texts of one mask, all fields converted as arrays."""
    spec = parser_of(mask)
    n = len(rows)
    if spec is None:
        return [None] * n
    kind, at = spec

    def col(k: str) -> np.ndarray:
        return np.array([r[at[k]] for r in rows], dtype=np.int64)

    none = np.full(n, -1, dtype=np.int64)
    if kind == "decade":
        return [f"{v // 10}0s" for v in col("dec")]
    if kind.startswith("epoch"):
        minutes = col("e") // (60 if kind == "epoch_s" else 60_000)
        return [f"{x}Z" for x in np.datetime_as_string(minutes.astype("datetime64[m]"))]
    if kind == "compact":
        v = col("c8")
        y, m, d = v // 10000, v // 100 % 100, v % 100
    elif kind == "dtg":
        g = [r[at["g"]] for r in rows]
        d = np.array([int(x[0]) for x in g], dtype=np.int64)
        if "m" in at:
            m, y = col("m"), _full_year(col("y"))
        else:
            m, y = np.array([MONTH_OF[x[4]] for x in g]), _full_year(np.array([int(x[5]) for x in g], dtype=np.int64))
    else:
        y = _full_year(col("y"))
        if kind == "ordinal":
            j = col("j")
            ok = (y >= 1) & (j >= 1) & (j <= 365 + (_month_length(np.maximum(y, 1), np.full(n, 2)) - 28))
            days = _days(np.maximum(y, 1), np.ones(n, dtype=np.int64), np.where(ok, j, 1))
            return [x if k else None for x, k in zip(np.datetime_as_string(days.astype("datetime64[D]")).tolist(), ok, strict=True)]
        m = col("m") if "m" in at else np.ones(n, dtype=np.int64)
        d = col("d") if "d" in at else np.ones(n, dtype=np.int64)
    ok = (y >= 1) & (m >= 1) & (m <= 12)
    y, m = np.where(ok, y, 1970), np.where(ok, m, 1)
    ok &= (d >= 1) & (d <= _month_length(y, m))
    d = np.where(ok, d, 1)
    if kind == "year":
        return [f"{a:04d}" if k else None for a, k in zip(y, ok, strict=True)]
    if kind == "month":
        return [f"{a:04d}-{b:02d}" if k else None for a, b, k in zip(y, m, ok, strict=True)]
    days = _days(y, m, d)
    hour = minute = none
    if kind == "dtg":
        hour, minute = np.array([int(x[1]) for x in g]), np.array([int(x[2]) for x in g])
    elif "h" in at:
        hour, minute = col("h"), col("n")
        if "p" in at:
            ok &= (hour >= 1) & (hour <= 12)
            hour = hour % 12 + col("p")
    elif "t4" in at:
        hour, minute = col("t4") // 100, col("t4") % 100
    elif "noon" in at:
        hour, minute = np.full(n, 12), np.zeros(n, dtype=np.int64)
    elif "midnight" in at:
        hour, minute = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    dates = np.datetime_as_string(days.astype("datetime64[D]")).tolist()
    if hour is none:
        return [x if k else None for x, k in zip(dates, ok, strict=True)]
    ok &= (minute < 60) & ((hour < 24) | ((hour == 24) & (minute == 0)))
    local = days * 1440 + hour * 60 + minute
    utc, known = local.copy(), np.zeros(n, dtype=bool)
    by_zone: dict[str | None, list[int]] = defaultdict(list)
    if kind == "dtg":
        fixed = [military_offset(x[3]) for x in g]
    elif "z" in at:
        fixed = [ZONES[r[at["z"]]] for r in rows]
    elif "s" in at:
        size = col("oh") * 60 + col("om") if "oh" in at else col("o4") // 100 * 60 + col("o4") % 100
        ok &= size <= 18 * 60
        fixed = list(np.where(mask[at["s"]] == "-", -size, size))
    else:
        fixed = [None] * n
    named = mask.endswith("E")
    for i, f in enumerate(fixed):
        if f is not None:
            utc[i] -= f
            known[i] = True
        else:
            by_zone[rows[i][-1] if named else zones[i]].append(i)
    for zone, ids in by_zone.items():
        if zone and (t := tables.get(zone) or zone_table(zone)):
            utc[ids] = t.to_utc(local[ids])
            known[ids] = True
    stamps = np.datetime_as_string(utc.astype("datetime64[m]")).tolist()
    return [(f"{s}Z" if w else x) if k else None for s, x, k, w in zip(stamps, dates, ok, known, strict=True)]


def normalise_texts(texts: list[str | None], zones: list[str | None], tables: dict[str, ZoneTable] | None = None) -> list[str | None]:
    """Normal forms of many texts at once; zones are the IANA zones for times that name none."""
    out: list[str | None] = [None] * len(texts)
    groups: dict[str, list[int]] = defaultdict(list)
    cut: dict[str, tuple[str, list]] = {}
    parts: list[list] = [[]] * len(texts)
    for i, t in enumerate(texts):
        if t:
            if t not in cut:
                cut[t] = tokenise(t)
            mask, parts[i] = cut[t]
            if mask:
                groups[mask].append(i)
    for mask, ids in groups.items():
        for i, form in zip(ids, _convert(mask, [parts[i] for i in ids], [zones[i] for i in ids], tables or {}), strict=True):
            out[i] = form
    return out


def normalise_timestamps(df: DataFrame, text: str, zone: str, out: str = "normal_form", zones: list[str] | None = None) -> DataFrame:
    """df with the normal form of its text column in column out.

    text: the dates as typed; zone: a column with the IANA zone for times without zone or offset; zones: zones whose
    tables are built once on the driver (a fixed list) and sent along, so that all executors use one tz version.

    Forms: YYYY-MM-DDTHH:MMZ (UTC), YYYY-MM-DD, YYYY-MM, YYYY, YYY0s. Defined results: null or blank text, impossible
    dates and texts without a date give null; a local time whose zone is null or unknown gives its date alone; repeated
    rows and other columns (whatever their names) pass through unchanged; an empty table gives an empty table.
    """
    tables = {z: t for z in zones or [] if (t := zone_table(z))}

    @F.pandas_udf("string")
    def form(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, z in it:
            yield pd.Series(normalise_texts([x if isinstance(x, str) else None for x in t], [x if isinstance(x, str) else None for x in z], tables), dtype=object)

    return df.withColumn(out, form(F.col(text), F.col(zone)))
