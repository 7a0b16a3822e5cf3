"""Matching rows of two tables that share no key: features, exact blocking, and a Gaussian mixture fitted without labels.

1. Both tables are brought to one shape: place and region read from free text, a span of days, and what is told of the thing
   seen: nouns and descriptions known from a column of noun phrases, and measures with their units.
   Misspelt places are led to the frequent spelling at most two edits away.
2. Pairs are formed on the place together with the decade, or with a shared noun or description where a side has no date: far
   more than match, and the unmatched ones among them are what the mixture learns its second part from. Hot places are dealt out to several tasks.
3. Graded similarity vectors of all pairs get a mixture of two Gaussians with regularised variances, fitted without labels: expectation steps are
   Catalyst expressions, maximisation steps one aggregation. In every expectation step the posteriors are made transitive:
   of two pairs that share a row, the second can't be matched if the sides that must then agree contradict each other.
   No feature is exempt: each may move the log odds by the same bound at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.timestamps import normalise_texts
from evidex.llm.names import fold, osa
from evidex.session import drop_scratch, keep_only, scratch_dir, written

# Words around a place name that are no part of it, and short forms of the countries' and regions' words.
_AROUND = re.compile(r"\babout\b|\b\d+\s*(?:km|mi|miles)\b|\boff\b|\b(?:n|s|e|w|ne|nw|se|sw|nne|sse)\s+of\b|\bof\b|\bnear\b|\bvic(?:inity)?\b|\bover\b|\bharbour\b|\bair station\b|\bstation\b|\broad between\b|\bthe\b|\bline\b|\bapprox(?:imately)?\b|\boutside\b|\barea\b")
_GENERIC = re.compile(r"^(?:restricted|undisclosed|unknown|various|not stated|withheld|classified|redacted|n/?a|unspecified|multiple|several|worldwide|location|at sea|airborne)|\b(?:aor|orbit|ocean|approaches|airspace|theat(?:er|re))$")
_SEGMENTS = re.compile(r"[,;/:()|]| and | about ")
# it begins with its first digit, for which texts are searched fast; no word goes on before it
_DURATION = re.compile(r"(\d(?<!\w\d)\d{0,5})[ -](second|minute|hour)s?\b", re.IGNORECASE)
_HEIGHT = re.compile(r"\b(\d{1,3}(?:,\d{3})+|\d{1,6})[ -](?:feet|foot|ft)\b", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)*")
_HYPHEN = re.compile(r"(?<=[a-z])-\s*(?=[a-z])")
_OTHER = re.compile(r"[^a-z ]")
_RUNS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[a-z-]+")


class Regions:
    """The fixed list of regions and countries: tells whether a piece of text names one, short forms and noise allowed."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names = sorted({fold(r) for r, _ in rows})
        self.countries = sorted({fold(c) for _, c in rows})
        self.bigrams = {n: {n[i : i + 2] for i in range(len(n) - 1)} for n in ("".join(r.split()) for r in self.names)}
        # what a piece of so many letters, or of so many words, may name
        joined = [(r, "".join(r.split())) for r in self.names]
        most = 2 + max((len(n) for n in [*self.countries, *self.bigrams]), default=0)
        self.near_countries = {n: [c for c in self.countries if abs(len(c) - n) <= 1] for n in range(1, most + 1)}
        self.near_names = {n: [x for x in joined if abs(len(x[1]) - n) <= 2] for n in range(1, most + 1)}
        self.of_words: dict[int, list[tuple[str, list[str]]]] = {}
        for r in self.names:
            self.of_words.setdefault(len(r.split()), []).append((r, r.split()))
        self.cache: dict[str, str | None] = {}

    def find(self, piece: str) -> str | None:
        """The region, '' for a country, None for anything else."""
        if piece not in self.cache:
            self.cache[piece] = self._find(piece)
        return self.cache[piece]

    def _find(self, piece: str) -> str | None:
        words = _RUNS.findall(piece)
        if not words:
            return None
        whole = "".join(words)
        if any(_one_edit(whole, c) for c in self.near_countries.get(len(whole), ())) or (len(words) == 1 and len(whole) == 3 and any(c.startswith(whole) for c in self.countries)):
            return ""
        if near := self.near_names.get(len(whole)):
            own = {whole[i : i + 2] for i in range(len(whole) - 1)}
            for r, joined in near:
                # an edit takes at most three pairs of letters away
                if len(own & self.bigrams[joined]) >= len(self.bigrams[joined]) - 6 and osa(whole, joined, 2) <= 2:
                    return r
        best = None
        for r, parts in self.of_words.get(len(words), ()):
            if all(_short(a, b) for a, b in zip(words, parts, strict=True)):
                best = r
        return best


def _one_edit(a: str, b: str) -> bool:
    """osa(a, b, 1) <= 1; words of three letters and more that one edit parts have the first or the last letter in common."""
    return a == b or (abs(len(a) - len(b)) <= 1 and (len(a) < 3 or len(b) < 3 or a[0] == b[0] or a[-1] == b[-1]) and osa(a, b, 1) <= 1)


def _short(a: str, b: str) -> bool:
    """a is b, a misspelling of it, or a short form: its first letter and letters of it in order."""
    if a == b or (len(b) > 4 and _one_edit(a, b)):
        return True
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


def read_place(text: str | None, regions: Regions) -> tuple[str, str]:
    """(place, region) of a free text; empty where it names none."""
    if not text:
        return "", ""
    s = fold(text)
    s = _HYPHEN.sub("", s)
    if _GENERIC.search(s.strip()):
        return "", ""
    place, region = "", ""
    for piece in _SEGMENTS.split(_AROUND.sub(lambda m: "," if m[0] in ("off", "of") else " ", s.replace(".", " "))):
        piece = _OTHER.sub("", piece).strip()
        if not piece:
            continue
        r = regions.find(piece)
        if r is None:
            w = "".join(piece.split())
            if len(w) > len(place):
                place = w
        elif r:
            region = r
    return (place if len(place) >= 4 else ""), region


def read_object(text: str | None) -> tuple[str, str]:
    """(shape, colour) of a noun phrase: its last word and what stands before it."""
    w = _PARTS.findall(fold(text or ""))
    return (w[-1], " ".join(w[:-1])) if w else ("", "")


class Phrases:
    """The nouns and the describing words that noun phrases of a table are made of: tells which of them a text mentions."""

    def __init__(self, heads: list[str], words: list[str]):
        self.heads, self.words = set(heads), set(words)

    def find(self, text: str | None) -> list[tuple[str, str]]:
        """(noun, description) of every known noun in a text, in order; the description is '' where no known word stands before it."""
        out: list[tuple[str, str]] = []
        ws = _WORDS.findall(fold(text or ""))
        for i in [i for i, w in enumerate(ws) if w in self.heads]:
            w = ws[i]
            if (w not in self.words or i + 1 == len(ws) or ws[i + 1] not in self.heads):
                j = i
                while j > 0 and ws[j - 1] in self.words:
                    j -= 1
                out.append((w, " ".join(ws[j:i])))
        return out


def known_phrases(df: DataFrame, phrase: str, min_share: float = 0.0005) -> Phrases:
    """The nouns (last words) and describing words (the others) that stand in at least min_share of a column's phrases: at most 1 / min_share and a few times as many words, however long the table."""
    words = F.regexp_extract_all(F.lower(F.col(phrase)), F.lit("([a-z-]+)"))
    phrases = df.groupBy(F.col(phrase)).agg(F.count(F.lit(1)).alias("times")).select("times", words.alias("w")).filter("size(w) > 0")
    rows = phrases.select("times", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("w"), (i == F.size("w") - 1).alias("head")))).alias("x")).select("times", "x.*")
    n = rows.groupBy("head", "w").agg(F.sum("times").alias("n"))
    total = n.filter("head").agg(F.sum("n").alias("total"))
    got = n.crossJoin(F.broadcast(total)).filter(F.col("n") >= min_share * F.col("total")).select("head", "w").collect()  # total: one row
    return Phrases(sorted(r.w for r in got if r.head), sorted(r.w for r in got if not r.head))


def read_account(title: str | None, account: str | None, known: Phrases, phrase: str | None = None) -> tuple[list[str], list[str], list[float], list[float]]:
    """(nouns, descriptions, seconds, feet) that a title, an account and a noun phrase tell of the thing seen.

    The noun phrase names it, else the title, else every noun that the account mentions may be it. Where only the noun is
    known, the account's descriptions of that noun count. All measures of time and height in the account may be its own.
    """
    told = known.find(account)
    shape, colour = read_object(phrase)
    if not shape and (named := known.find(title)):
        shape, colour = named[-1]
    if shape:
        heads, colours = [shape], [colour] if colour else sorted({c for h, c in told if h == shape and c})
    else:
        heads, colours = sorted({h for h, _ in told}), sorted({c for _, c in told if c})
    seconds = sorted({float(int(m[1]) * {"s": 1, "m": 60, "h": 3600}[fold(m[2])[0]]) for m in _DURATION.finditer(account or "")})
    feet = sorted({float(m[1].replace(",", "")) for m in _HEIGHT.finditer(account)}) if account and _names_feet(account) else []
    return heads, colours, seconds, feet


def _names_feet(text: str) -> bool:
    """False only where _HEIGHT finds nothing."""
    return not text.isascii() or "ft" in (low := text.lower()) or "feet" in low or "foot" in low


_EPOCH = date(1970, 1, 1).toordinal()


def read_span(form: str | None) -> tuple[int, int, str]:
    """(first day, last day, precision) of a normal form, days since 1970; precision '' without a date."""
    if not form:
        return 0, 0, ""
    if len(form) >= 10:
        n = date(int(form[:4]), int(form[5:7]), int(form[8:10])).toordinal() - _EPOCH
        return n, n, "D"
    day = lambda y, m=1, d=1: date(y, m, d).toordinal() - _EPOCH
    if form.endswith("s"):
        y = int(form[:4])
        return day(y), day(y + 10) - 1, "T"
    y = int(form[:4])
    if len(form) == 7:
        m = int(form[5:7])
        last = date(y + m // 12, m % 12 + 1, 1) - timedelta(days=1)
        return day(y, m), last.toordinal() - _EPOCH, "M"
    return day(y), day(y + 1) - 1, "Y"


SHAPE = "side string, id string, place string, region string, lo int, hi int, prec string, heads array<string>, colours array<string>, seconds array<double>, feet array<double>"
ARROW = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] + [pa.list_(pa.string())] * 2 + [pa.list_(pa.float64())] * 2
ARROW_SCHEMA = pa.schema(list(zip((c.split()[0] for c in SHAPE.split(", ")), ARROW, strict=True)))


def prepare(df: DataFrame, side: str, columns: dict[str, str], regions: list[tuple[str, str]], phrases: Phrases) -> DataFrame:
    """df in the common shape. columns: names of id, place, dated, title, account and optionally day, phrase, region, seconds, feet."""
    src = df.select(*(F.col(v).alias(k) for k, v in columns.items())).filter("id is not null")
    if "day" in columns:
        src = src.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    known = Regions(regions)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = lru_cache(maxsize=50_000)(lambda text: read_place(text, known))
        for batch in it:
            cols = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))
            none = [None] * batch.num_rows
            get = lambda c: [x if isinstance(x, str) else None for x in cols.get(c, none)]  # noqa: B023, E731
            num = lambda c: [float("nan") if x is None else float(x) for x in cols.get(c, none)]  # noqa: B023, E731
            forms = normalise_texts(get("dated"), none)
            rows = []
            for i, place, form, day, title, account, phrase, region, sec, ft in zip(get("id"), get("place"), forms, get("day"), get("title"), get("account"), get("phrase"), get("region"), num("seconds"), num("feet"), strict=True):
                p, r = place_of(place)
                lo, hi, prec = read_span(form or day)
                if not form and day and day.endswith("-01"):  # a day alone may be cut to its month, year or decade
                    lo, hi, prec = read_span(day[:7] if not day.endswith("-01-01") else day[:3] + "0s" if day[3] == "0" else day[:4])
                heads, colours, s, f = read_account(title, account, phrases, phrase)
                rows.append((side, i, p, r or fold(region or ""), lo, hi, prec, heads, colours, [sec] if sec == sec else s, [ft] if ft == ft else f))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(ARROW), ARROW, strict=True)], schema=ARROW_SCHEMA)

    return src.mapInArrow(run, SHAPE)


def shortened(word: str) -> list[str]:
    """word and what is left of it without one letter, or two where it is long: words two edits apart share one of them."""
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    twice = {w[:i] + w[i + 1 :] for w in once for i in range(len(w))} if len(word) >= 8 else set()
    return sorted({word} | once | twice)


def settle_places(rows: DataFrame) -> DataFrame:
    """rows with columns spelt (the place as read), sure and keys (under which a row meets the other side): each rare place is led to the most frequent one at most two edits away that is at least three times as frequent.

    sure is the share of a place's rows that lie in its commonest region: a name that lies everywhere tells little.
    """
    cells = rows.filter("place <> ''").groupBy("place", "region").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy("place").agg(F.sum("n").alias("n"))

    @F.pandas_udf("array<string>")
    def cut(p: pd.Series) -> pd.Series:
        return pd.Series([shortened(x) for x in p], dtype=object)

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, 2) for x, y in zip(a, b, strict=True)])

    # keys are hashes of 64 bits: a collision only costs a comparison
    keyed = counts.select("place", "n", F.explode(cut("place")).alias("w")).select("place", "n", F.xxhash64("w").alias("k"))
    near = keyed.select(F.col("place").alias("a"), F.col("n").alias("na"), "k").join(keyed.filter("n >= 3").select(F.col("place").alias("b"), F.col("n").alias("nb"), "k"), "k")
    near = near.filter("a <> b and nb >= 3 * na").select("a", "b", "na", "nb").distinct()
    # said to be nondeterministic only so that it isn't moved before distinct(), where a pair stands once for each shared key
    near = near.withColumn("e", edits.asNondeterministic()("a", "b")).filter("e <= 2")
    best = near.groupBy("a").agg(F.max_by("b", F.struct(-F.col("e"), "nb", "b")).alias("settled"))
    cells = cells.join(best.withColumnRenamed("a", "place"), "place", "left").withColumn("settled", F.coalesce("settled", "place"))
    told = F.sum(F.when(F.col("region") != "", F.col("n")))
    spread = cells.groupBy("settled", "region").agg(told.alias("n")).groupBy("settled").agg((F.max("n") / F.sum("n")).alias("sure"))
    known = cells.select("place", "settled").distinct().join(spread, "settled", "left")
    rows = rows.join(known, "place", "left").select(*(c for c in rows.columns if c != "place"), F.coalesce("settled", "place").alias("place"), F.col("place").alias("spelt"), F.coalesce("sure", F.lit(1.0)).alias("sure"))
    return rows.withColumn("keys", F.when(F.col("side") == "a", _keys(1)).otherwise(_keys(0)))


def _decades(days: int) -> Column:
    """The decades that a row's span touches, give or take some days."""
    at = lambda c: F.floor(F.year(F.date_add(F.lit("1970-01-01").cast("date"), c)) / 10)
    return F.sequence(at(F.col("lo") - days), at(F.col("hi") + days))


def _keys(days: int) -> Column:
    """Keys (hashes of 64 bits) under which a row meets the other side at its place: each decade that it may lie in; where a side has no date, a noun or a description that both tell."""
    told = F.concat(F.transform("heads", lambda x: F.concat(F.lit("h"), x)), F.transform("colours", lambda x: F.concat(F.lit("c"), x)))
    dated = F.when(F.col("prec") != "", F.transform(_decades(days), lambda x: F.concat(F.lit("t"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    # N0: neither side has a date, N1: the left one has none, N2: the right one
    own, other = ("N1", "N2") if days else ("N2", "N1")
    undated = F.when(F.col("prec") == "", F.flatten(F.transform(told, lambda x: F.array(F.concat(F.lit("N0"), x), F.concat(F.lit(own), x))))).otherwise(F.transform(told, lambda x: F.concat(F.lit(other), x)))
    return F.array_distinct(F.transform(F.concat(dated, undated), lambda x: F.xxhash64("place", x)))


FEATURES = ("f_place", "f_region", "f_time", "f_object", "f_colour", "f_seconds", "f_feet")
#: Rows of one side that a task meets the other side's with; a place and time of more is spread over several tasks.
SPREAD = 2000
#: Keys that may be dealt out, at most: their list is sent to all tasks.
MOST_HOT = 100_000


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one place that fall into one decade, or share a noun or description where a side has no date, with their similarity vectors in [0, 1], UNKNOWN where a side tells nothing.

    Most pairs of one decade are of different sightings: they are what the mixture learns unmatched pairs from. The left
    rows of a place and key are dealt out in groups of about SPREAD, and the right rows sent to each group, so no task holds a
    hot place whole; no pair is left out.
    """
    names = ("id", "keys", "spelt", "sure", "region", "lo", "hi", "prec", "heads", "colours", "seconds", "feet")
    l, r = left.filter("place <> ''"), right.filter("place <> ''")
    # a key that is dealt out holds a share of 1 / MOST_HOT of all keys, so at most MOST_HOT are sent
    spread = max(SPREAD, (l.agg(F.sum(F.size("keys"))).first()[0] or 0) // MOST_HOT)
    l, r = l.withColumn("k", F.explode("keys")), r.withColumn("k", F.explode("keys"))
    hot = F.broadcast(l.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / spread).alias("parts")).filter("parts > 1"))
    l = l.join(hot, "k", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    r = r.join(hot, "k", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    pairs = l.select("k", "part", *(F.col(c).alias(f"{c}_a") for c in names)).join(r.select("k", "part", *(F.col(c).alias(f"{c}_b") for c in names)), ["k", "part"])
    # a pair that meets under several keys is made under the first
    pairs = pairs.filter(F.col("k") == F.array_min(F.array_intersect("keys_a", "keys_b")))
    none = lambda c: (F.size(f"{c}_a") == 0) | (F.size(f"{c}_b") == 0)
    shared = lambda c: F.when(none(c), UNKNOWN).otherwise(F.arrays_overlap(f"{c}_a", f"{c}_b").cast("double"))
    ratio = lambda c: F.when(none(c), UNKNOWN).otherwise(F.array_max(F.flatten(F.transform(f"{c}_a", lambda x: F.transform(f"{c}_b", lambda y: F.least(x, y) / F.greatest(x, y, F.lit(1.0)))))))
    gap = F.greatest(F.col("lo_a") - F.col("hi_b"), F.col("lo_b") - F.col("hi_a"), F.lit(0))
    width = F.greatest(F.col("hi_a") - F.col("lo_a"), F.col("hi_b") - F.col("lo_b"), gap) + 1
    # compatible times tell the more, the narrower they are, and nothing as wide as the decade that all pairs share
    time = (
        F.when((F.col("prec_a") == "") | (F.col("prec_b") == ""), UNKNOWN).when(gap > 1, 0.5 - 0.5 * F.log(gap + 1.0) / F.log(F.lit(7306.0)))
        .when(width > 366, UNKNOWN).otherwise(1.0 - 0.2 * F.log(width.cast("double")) / F.log(F.lit(366.0)))
    )
    only = lambda c: F.when(F.size(c) == 1, F.hash(F.col(c)[0]))
    about = lambda s: (F.when(F.col(f"prec_{s}") != "", F.col(f"lo_{s}")).alias(f"lo_{s}"), F.col(f"hi_{s}"), only(f"heads_{s}").alias(f"head_{s}"), only(f"colours_{s}").alias(f"colour_{s}"))
    longest = F.greatest(F.length("spelt_a"), F.length("spelt_b"))
    region = F.when((F.col("region_a") == "") | (F.col("region_b") == ""), UNKNOWN).otherwise((F.col("region_a") == F.col("region_b")).cast("double"))
    return pairs.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), ((1 - F.levenshtein("spelt_a", "spelt_b") / longest) * F.least("sure_a", "sure_b")).alias("f_place"), region.alias("f_region"), time.alias("f_time"),
        shared("heads").alias("f_object"), shared("colours").alias("f_colour"), ratio("seconds").alias("f_seconds"), ratio("feet").alias("f_feet"),
        F.when((F.col("prec_a") == "") | (F.col("prec_b") == ""), 0).when(time == UNKNOWN, 1).otherwise(2).alias("stratum"), *(x for s in "ab" for x in about(s)),
    )


#: What of a row decides whether two partners of one row can be the same sighting: its span (lo is null without a date), and hashes of
#: its noun and description where it tells just one.
ABOUT = ("lo", "hi", "head", "colour")
#: A feature of which a side tells nothing; it has no part in the densities.
UNKNOWN = -1.0


STRATA = (0, 1, 2)


class Mixture:
    """Two Gaussians over similarity vectors, matched and unmatched, with regularised variances; unknown features are left out.

    most: how far any one feature may move the log odds of a pair: no feature decides against all others.
    """

    def __init__(self, sums: dict[str, Row], ridge: float = 0.05, most: float = 6.0):
        """From the sums of sufficient_sums() of one stratum under some posteriors."""
        self.most = most
        at = lambda what: np.array([[float(sums[f][f"{what}{k}"]) if f in sums else 0.0 for f in FEATURES] for k in (0, 1)])
        n, x, xx = at("n"), at("x"), at("xx")
        w = np.array([float(sums["all"]["n0"]), float(sums["all"]["n1"])])
        self.weight = np.maximum(w / max(w.sum(), 1e-9), 1e-4)
        # one pseudo-count at the common mean
        centre = x.sum(0) / np.maximum(n.sum(0), 1e-9)
        self.mu = (x + centre) / (n + 1)
        # the distance of the means keeps a feature that hardly varies within a part from deciding alone
        gap = ridge * (self.mu[0] - self.mu[1]) ** 2 + 2e-3
        self.var = np.maximum(xx - 2 * self.mu * x + n * self.mu**2, 0) / (n + 1) + gap

    def numbers(self) -> list[float]:
        """Log odds before any feature, and the bound; of each feature the three numbers of a parabola: what it adds to the log odds within the bound."""
        out = [float(np.log(self.weight[0] / self.weight[1])), self.most]
        for i in range(len(FEATURES)):
            m, v = self.mu[:, i], self.var[:, i]
            square = 0.5 * (1 / v[1] - 1 / v[0])
            line = m[0] / v[0] - m[1] / v[1]
            rest = 0.5 * (m[1] ** 2 / v[1] - m[0] ** 2 / v[0] + np.log(v[1] / v[0]))
            out += [float(rest), float(line), float(square)]
        return out

    def column(self) -> Column:
        """The posterior as a Catalyst expression, whatever the stratum."""
        return posterior({k: self for k in STRATA})

    def likelihood(self, row: dict[str, float]) -> float:
        """Posterior of one similarity vector."""
        odds = np.log(self.weight[0] / self.weight[1])
        for i, c in enumerate(FEATURES):
            if (x := row[c]) >= 0:
                d = (x - self.mu[:, i]) ** 2 / self.var[:, i] + np.log(self.var[:, i])
                odds += np.clip(0.5 * (d[1] - d[0]), -self.most, self.most)
        return float(1 / (1 + np.exp(np.clip(-odds, -500, 500))))


def posterior(mixtures: dict[int, Mixture]) -> Column:
    """The posterior of each pair under the mixture of its stratum, as a Catalyst expression.

    The numbers are looked up by stratum in one array and the features gone through by a higher-order function: written out, with the numbers in it,
    the expression is code of over 8,000 bytes, which JVMs don't compile, and is another one in each round.
    """
    width = 2 + 3 * len(FEATURES)
    numbers = F.lit([x for k in STRATA for x in (mixtures[k].numbers() if k in mixtures else [0.0] * width)])
    at = lambda i: F.get(numbers, F.col("stratum") * width + i)

    def term(x: Column, i: Column) -> Column:
        y = at(3 * i + 2) + x * (at(3 * i + 3) + x * at(3 * i + 4))
        return F.when(x >= 0, F.greatest(-at(1), F.least(at(1), y))).otherwise(0.0)

    odds = F.aggregate(F.transform(F.array(*FEATURES), term), at(0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def sufficient_sums(pairs: DataFrame, g: str) -> dict[int, dict[str, Row]]:
    """By stratum and feature (and 'all'), the sums that a maximisation step needs under the posteriors in column g: at most 24 rows, whatever the data."""
    cells = ", ".join(f"named_struct('f', '{f}', 'x', {f})" for f in FEATURES)
    rows = pairs.selectExpr("stratum", f"{g} as g", f"inline(array(named_struct('f', 'all', 'x', 1D), {cells}))").filter("x >= 0")
    sums = [F.expr(f"sum({w} * {x})").alias(f"{n}{k}") for k, w in ((0, "g"), (1, "(1 - g)")) for n, x in (("n", "1D"), ("x", "x"), ("xx", "x * x"))]
    out: dict[int, dict[str, Row]] = {}
    for r in rows.groupBy("stratum", "f").agg(*sums).collect():
        out.setdefault(r["stratum"], {})[r["f"]] = r
    return out


def transitive(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, post, ...) with posteriors that respect transitivity towards the best partner of each row.

    If (a, b) and (a, c) match, b and c are the same; where their times exclude each other, or one has no date and what they
    tell differs, the weaker of the two pairs keeps only what the stronger leaves. The best partner is a maximum over the row's
    pairs, which one sort brings together (and spills where they are many); the partners of a row are never gathered in a list.
    """
    out = pairs
    keep = F.lit(1.0)
    for own, other in (("a", "b"), ("b", "a")):
        about = [F.col(f"{c}_{other}").alias(c) for c in ABOUT]
        out = out.withColumn(f"best_{own}", F.max(F.struct("post", F.col(other).alias("id"), *about)).over(W.partitionBy(own)))
        b = F.col(f"best_{own}")
        mine = lambda c: F.col(f"{c}_{other}")  # noqa: B023, E731
        apart = (mine("lo") > b["hi"] + 1) | (b["lo"] > mine("hi") + 1)
        clash = F.coalesce(mine("head") != b["head"], F.lit(False)) | F.coalesce(mine("colour") != b["colour"], F.lit(False))
        conflict = (F.col(other) != b["id"]) & F.coalesce(apart, clash)
        keep = keep * F.when(conflict, 1 - b["post"]).otherwise(1.0)
    return out.withColumn("post", F.col("post") * keep).select(*pairs.columns)


def match(left: DataFrame, right: DataFrame, rounds: int = 4, in_play: float = 0.01) -> DataFrame:
    """(a, b, confidence): pairs of a row of left and a row of right (both from prepare()) with the posterior of a match.

    Pairs whose times can be compared, pairs with a decade alone on a side, and pairs without a date on a side are three strata, each with its own mixture, because what they share already differs. Every round
    is an expectation step with transitivity and a maximisation step; the first posteriors come from the mean similarity. A pair
    whose posterior is under in_play rules nothing out and has next to nothing to lose, and is left out of the transitive step.
    Defined results: rows without a place match nothing (a date alone is no case), nor do rows of which one has no date and
    one tells nothing of the thing seen; of rows with one id any one counts; no pairs give an empty table. What is collected
    are three rows of sums a round, whatever the data.
    """
    spark = left.sparkSession
    root = scratch_dir(spark)
    read = written(left.unionByName(right).dropDuplicates(["side", "id"]).filter("place <> ''"), f"{root}/read")
    rows = written(settle_places(read), f"{root}/rows")
    drop_scratch(spark, f"{root}/read")
    pairs = written(candidate_pairs(rows.filter("side = 'a'"), rows.filter("side = 'b'")), f"{root}/pairs")
    known = reduce(lambda s, f: s + F.when(F.col(f) >= 0, 1).otherwise(0), FEATURES, F.lit(0))
    mean = reduce(lambda s, f: s + F.greatest(F.col(f), F.lit(0.0)), FEATURES, F.lit(0.0)) / known
    scored = pairs.withColumn("post", (mean > FIRST_MEAN).cast("double"))
    for _ in range(max(rounds, 1)):
        mixtures = {k: Mixture(r) for k, r in sufficient_sums(scored, "post").items()}
        if not mixtures:
            return pairs.select("a", "b", F.lit(0.0).alias("confidence")).limit(0)
        every = pairs.withColumn("post", F.explode(F.array(posterior(mixtures))))  # exploded, it is computed once for filters and columns
        scored = transitive(every.filter(F.col("post") >= in_play)).unionByName(every.filter(F.col("post") < in_play))
    scored = written(scored.select("a", "b", F.col("post").alias("confidence")), f"{root}/scored")
    keep_only(spark, root, "scored")
    return scored


#: Mean similarity from which a pair counts as matched before the first round.
FIRST_MEAN = 0.75
