"""Repair of text from scanned pages: page furniture, words cut at line ends, misread words, and reflow into paragraphs.

1. Words are counted over all pages. Words meet far more frequent ones under the strokes that their glyphs are made of, and are
   linked if one plausible confusion of glyphs turns one into the other.
2. A second pass over the pages gathers, at once, the lines at page edges, words that are not known as usual with the
   words around them, words cut at line ends, and counts of neighbouring usual words.
3. Skip-gram vectors with negative sampling are trained on all of these counts, in shards whose results are averaged. Where a word stands, the
   linked word whose vector fits the words around it best is what was printed; where none fits it stays.
4. Lines at page edges are compared over the pages of a file and, with rare words masked, over all files; the rest is joins.

What the tasks are sent has a size that is bounded by shares of the corpus: usual words (at most 1 / USUAL_SHARE) and words with vectors
(at most 1 / MODEL_SHARE). All others are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.session import keep_only, scratch_dir, written

#: A word that is so large a part of all words is usual; one of the other share has a vector.
USUAL_SHARE, MODEL_SHARE = 2e-6, 5e-5

# Glyphs that scanners take for one another: what is read -> what may have been printed.
CONFUSIONS = {
    "rn": "m", "m": "rn in ni nn", "cl": "d", "d": "cl", "vv": "w", "w": "vv", "li": "h u n", "ri": "n", "ii": "u n", "il": "u", "in": "m", "im": "un", "iii": "m", "nn": "m", "h": "b li", "b": "h 6 l", "c": "e o", "e": "c o",
    "o": "a e c", "a": "o s e u", "u": "n ii a", "n": "u ri h", "v": "y", "y": "v", "f": "t", "t": "f l i r", "l": "i t", "i": "l t", "s": "5 a", "g": "q 9", "q": "g", "r": "t", "j": "i", "z": "s", "k": "h lc",
}
# Digits and signs read in place of letters.
SIGNS = {"0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "!": "il", "|": "li", "$": "s", "(": "c", "+": "t", "]": "l", "[": "l", "/": "l", "\\": "l", "{": "c", "}": "j", "€": "e", "£": "e", "&": "g", "*": "x", "%": "x", "<": "c", "#": "h"}
BREAKS = "-\xad¬"
_TOKEN = re.compile(r"\S+")
_EDGE_PUNCTUATION = "\"'“”‘’()[]{}.,;:!?*"
_PAGE_NUMBER = re.compile(r"^[\W_]*(?:page|p[o0]ge|pag[ec]|p\.?|pg\.?|sheet)?[\W_]*(?:[0-9lio]{1,4}|[ivxl]{1,7})(?:\s*(?:of|0f|/)\s*[0-9lio]{1,4})?[\W_]*$", re.IGNORECASE)
_ORDINARY = re.compile(r"^(?:\d[\d.,:/-]*(?:st|nd|rd|th|d|s|m|km|ft|am|pm)?|[a-z]|.*\d.*\d.*\d.*|(?:one|two|three)-\d+th|[a-z]\.(?:[a-z]\.?)+)$", re.IGNORECASE)


def strip_accents(w: str) -> str:
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    return token.strip(_EDGE_PUNCTUATION).lower()


# The strokes of glyphs; what one confusion turns into another mostly has the same.
STROKES = {"a": "c", "c": "c", "e": "c", "o": "c", "s": "c", "z": "c", "d": "ci", "u": "ii", "n": "ii", "h": "ii", "b": "ii", "m": "iii", "r": "i", "l": "i", "i": "i", "t": "i", "f": "i", "j": "i", "v": "v", "y": "v", "w": "vv", "g": "g", "q": "g"}


def strokes(word: str) -> str:
    """A word as strokes of its letters; signs are read as the first letter that they may be."""
    return "".join(STROKES.get(x, x) for x in (SIGNS[c][0] if c in SIGNS else c for c in word))


#: Confusions and readings of signs whose strokes differ: words are looked up under these too.
_UNEVEN = sorted({(read, x) for read, xs in CONFUSIONS.items() for x in xs.split() if strokes(read) != strokes(x)} | {(c, x) for c, xs in SIGNS.items() for x in xs if strokes(x) != strokes(c)})


def lookups(word: str) -> list[str]:
    """The strokes of all that a word may have been in print."""
    w = strip_accents(word)
    out = {strokes(w)}
    for read, x in _UNEVEN:
        i = w.find(read)
        while i >= 0:
            out.add(strokes(w[:i] + x + w[i + len(read) :]))
            i = w.find(read, i + 1)
    return sorted(out)


def may_be(word: str, target: str) -> bool:
    """Whether a word may be a misreading of another: signs and accents brought to letters, and at most one confusion of letters undone."""
    w = strip_accents(word)
    if word == target:
        return False
    same = lambda a, b: a == b or b in SIGNS.get(a, "")
    n, m = len(w), len(target)
    p = 0
    while p < min(n, m) and same(w[p], target[p]):
        p += 1
    if p == n == m:
        return True
    s = 0
    while s < min(n, m) and same(w[n - 1 - s], target[m - 1 - s]):
        s += 1
    for i in range(max(0, n - s - 3), min(p, n - 1) + 1):
        for k in (1, 2, 3):
            for x in CONFUSIONS.get(w[i : i + k], "").split():
                if n - i - k == m - i - len(x) <= s and target[i : i + len(x)] == x:
                    return True
    return False


def odd_glyphs(word: str) -> bool:
    """Whether a word holds signs, digits or accents that no English word has."""
    return not _ORDINARY.match(word) and any(c.isalpha() for c in word) and (not word.isascii() or any(c in SIGNS for c in word))


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _body_words(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(line index, word as written without punctuation around) of all lines; a word cut at a line end is skipped with its rest."""
    cut = False
    for i, line in enumerate(lines):
        tokens = _TOKEN.findall(line)
        if not tokens:
            continue
        first = 1 if cut else 0
        cut = tokens[-1][-1] in BREAKS and len(tokens[-1]) > 1
        for t in tokens[first : len(tokens) - 1 if cut else None]:
            yield i, t


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """(word, n): words of all pages in lower case; counted per task first."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for pdf in it:
            for t in pdf["text"]:
                c.update(w for _, x in _body_words(_lines(t)) if (w := core(x)))
            if len(c) > 500_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return pages.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def glyph_links(counts: DataFrame, min_ratio: float = 25.0, min_count: int = 10) -> DataFrame:
    """(word, n, target, m): words and the far more frequent words that they may be misreadings of; they meet under their strokes."""

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return pd.Series([lookups(w) for w in words], dtype=object)

    @F.pandas_udf("array<string>")
    def key(words: pd.Series) -> pd.Series:
        return pd.Series([[strokes(w)] for w in words], dtype=object)

    @F.pandas_udf("boolean")
    def fits(words: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([may_be(a, b) for a, b in zip(words, targets, strict=True)], dtype=bool)

    long = counts.filter(F.length("word") >= 3)
    v = long.select("word", "n", F.explode(keys("word")).alias("k")).select("word", "n", F.xxhash64("k").alias("k"))
    m = long.filter(F.col("n") >= min_count).select(F.col("word").alias("target"), F.col("n").alias("m"), F.explode(key("word")).alias("k")).select("target", "m", F.xxhash64("k").alias("k"))
    near = v.join(m, "k").filter((F.col("m") >= min_ratio * F.col("n")) & (F.abs(F.length("word") - F.length("target")) <= 2)).select("word", "n", "target", "m").distinct()
    return near.filter(fits("word", "target"))


# --- skip-gram vectors ------------------------------------------------------------------------------------------------


class Vectors:
    """Words and their two vectors each: v of a word, u of a word that stands near."""

    def __init__(self, words: list[str], v: np.ndarray, u: np.ndarray):
        self.ids, self.v, self.u = {w: i for i, w in enumerate(words)}, v, u

    def fit(self, word: str, around: list[int]) -> float | None:
        """How well a word fits the words around it: the mean product of the vectors, about their mutual information less the logarithm of the number of negatives; None if that is unknown."""
        i = self.ids.get(word)
        return None if i is None or not len(around) else float((self.u[around] @ self.v[i]).mean())


def _step(m: np.ndarray, seen: np.ndarray, rows: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
    """One step against the gradients g of rows of m, in place, divided by the root of the squares seen of each row (Adagrad), so that frequent words don't run away."""
    seen[rows] += (g * g).mean(1)
    m[rows] -= rate * g / np.sqrt(seen[rows] + 1e-8)[:, None]


def train(w: np.ndarray, c: np.ndarray, n: np.ndarray, v: np.ndarray, u: np.ndarray, noise: np.ndarray, passes: int, negative: int = 5, rate: float = 0.1) -> None:
    """Passes of skip-gram with negative sampling over all pairs (w, c), each with its weight n, in place; noise: the shares that negatives have.

    Nothing is drawn: a pair counts by its weight, and in place of drawn negatives stands what they come to on average.
    Words are taken in blocks; the pairs are sorted by w.
    """
    rows, first = np.unique(w, return_index=True)
    ends = np.r_[first[1:], len(w)]
    size = max(1, min(256, 4_000_000 // len(u)))
    seen_v, seen_u = np.zeros(len(v), np.float32), np.zeros(len(u), np.float32)
    for _ in range(passes):
        for i in range(0, len(rows), size):
            at = rows[i : i + size]
            own = slice(first[i], ends[min(i + size, len(rows)) - 1])
            met = np.zeros((len(at), len(u)), np.float32)
            met[np.searchsorted(at, w[own]), c[own]] = n[own]
            x = v[at]
            p = 1 / (1 + np.exp(-np.clip(x @ u.T, -30, 30)))
            g = (met + negative * met.sum(1)[:, None] * noise[None].astype(np.float32)) * p - met
            _step(v, seen_v, at, g @ u, rate)
            _step(u, seen_u, slice(None), g.T @ x, rate)


_BLOCK = 512


def _learner(sent: Broadcast, passes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What trains one shard of pairs from the vectors sent: how far each block of them moves."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        v, u, keep, noise = sent.value
        dv, du = v.copy(), u.copy()
        pdf = pdf.sort_values(["w", "c"])
        a, b = pdf["w"].to_numpy(), pdf["c"].to_numpy()
        train(a, b, (pdf["n"].to_numpy() * keep[a] * keep[b]).astype(np.float32), dv, du, noise, passes)
        dv, du = dv - v, du - u
        at = range(0, len(v), _BLOCK)
        return pd.DataFrame({"at": list(at), "shard": int(pdf["shard"].iloc[0]), "v": [dv[i : i + _BLOCK].tobytes() for i in at], "u": [du[i : i + _BLOCK].tobytes() for i in at]})

    return learn


def skip_grams(pairs: DataFrame, words: list[tuple[str, int]], dims: int = 32, shards: int = 8, rounds: int = 2, passes: int = 20, often: float = 1e-3) -> Vectors:
    """Vectors of words (with their counts) from the counts n of neighbours (w, c), both numbers in the list.

    Counts are exact over all pages and thinned by the usual sampling of frequent words (the expected share of it is kept, nothing is
    drawn), and every pair is trained with its count. Words fall into shards by hash; each shard trains its words from the vectors of the round
    before, and what it makes of the vectors u, which all shards move, is averaged: the result depends on the counts and the parameters
    alone. What reaches the driver are the moved vectors.
    """
    size = np.array([x for _, x in words], dtype=float)
    rng = np.random.default_rng(0)
    v, u = ((rng.random((len(words), dims)) - 0.5) / dims).astype(np.float32), np.zeros((len(words), dims), np.float32)
    if not words:
        return Vectors([], v, u)
    keep = np.minimum(1, np.sqrt(often / (size / size.sum())))
    noise = size**0.75
    noise /= noise.sum()
    spark = pairs.sparkSession
    shard = F.pmod(F.xxhash64("w"), F.lit(shards))
    counts = pairs.groupBy("w", "c").agg(F.sum("n").alias("n")).withColumn("shard", shard)
    root = scratch_dir(spark)
    counts = written(counts, f"{root}/counts")
    for _ in range(rounds):
        learn = _learner(spark.sparkContext.broadcast((v, u, keep, noise)), passes)

        def move(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")
            all_ = lambda c: [np.frombuffer(x, np.float32) for x in pdf[c]]
            return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "v": [np.sum(all_("v"), axis=0).tobytes()], "u": [np.mean(all_("u"), axis=0).astype(np.float32).tobytes()]})

        got = counts.groupBy("shard").applyInPandas(learn, "at long, shard int, v binary, u binary").groupBy("at").applyInPandas(move, "at long, v binary, u binary").collect()
        v, u = v.copy(), u.copy()
        for x in got:
            for m, b in ((v, x.v), (u, x.u)):
                m[x.at : x.at + _BLOCK] += np.frombuffer(b, np.float32).reshape(-1, dims)
    keep_only(spark, root)
    return Vectors([w for w, _ in words], v, u)


def print_of(marks: DataFrame, links: DataFrame, vectors: Vectors, least: float = -4.0, weight: float = 0.5) -> DataFrame:
    """marks (columns word and near, the numbers of the words around) with target, what was printed there, or null.

    Of the linked words the one with the highest logarithm of its count and, weighed, the fits of the words around it; none if
    that one has a fit under `least`. A word without a vector counts by its count alone.
    """
    some = links.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("target", "m"))).alias("some"))  # at most one a confusion of its glyphs
    sent = marks.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("string")
    def choose(some: pd.Series, near: pd.Series) -> pd.Series:
        known, out = sent.value, []
        for cs, ids in zip(some, near, strict=True):
            best = None
            for c in cs if cs is not None else ():
                fit = known.fit(c["target"], list(ids) if ids is not None else [])
                score = np.log(c["m"]) + weight * (fit * len(ids) if fit is not None else 0.0)
                if best is None or score > best[0]:
                    best = (score, c["target"], fit)
            out.append(best[1] if best and (best[2] is None or best[2] >= least) else None)
        return pd.Series(out, dtype=object)

    return marks.join(some, "word", "left").withColumn("target", F.when(F.col("some").isNotNull(), choose("some", "near"))).drop("some")


# --- page furniture ---------------------------------------------------------------------------------------------------

EDGE = 3
_WIDE = re.compile(r"\S(?: {3,}|\t)(?=\S)")


def mask_line(line: str) -> str:
    """A line in lower case without glyph noise, page numbers at its ends and spacing; digits are '#'. Empty for what is no header."""
    s = strip_accents(line.strip().lower())
    s = re.sub(r"^[\W_]*\d{1,4}[\W_]*\s{2,}|\s{2,}[\W_]*\d{1,4}[\W_]*$", "", s)
    if "|" in s or s[-1:] in ".,;" or len(_WIDE.findall(s)) >= 2:
        return ""
    s = re.sub(r"(?<=[a-z])[0!|15@](?=[a-z])", lambda m: {"0": "o", "!": "i", "|": "l", "1": "l", "5": "s", "@": "a"}[m[0]], s)
    s = re.sub(r"\d", "#", s)
    s = re.sub(r"\s+", " ", s).strip()
    return s if sum(c.isalpha() for c in s) >= 4 else ""


def furniture(lines: DataFrame, root: str, min_share: float = 0.1, min_files: int = 8, min_edge: float = 0.85) -> DataFrame:
    """(k0, k1, line_no): running headers, footers and page numbers among the edge_lines() of files (k0) and pages (k1).

    A line runs if, noise and numbers apart, it stands outermost on at least two pages and a tenth of the pages of its file,
    or, with rare words masked, in min_files files, and such lines hardly ever stand elsewhere. A misread one is known by its
    likeness to a running line of its file. Lines further in count only behind others that do.
    """
    edges = lines.filter("side <> ''")
    total = lines.filter("mask <> ''").dropDuplicates(["k0", "k1", "line_no"])
    outer = (F.col("r") == 0).cast("int")
    outermost = edges.groupBy("k0", "k1", "line_no").agg(F.min("r").alias("r0"))
    total = total.join(outermost, ["k0", "k1", "line_no"], "left").withColumn("edge", F.coalesce(F.col("r0") <= 1, F.lit(False)).cast("int"))
    by_mask = total.groupBy("mask").agg((F.sum("edge") / F.count(F.lit(1))).alias("mask_edge"))
    by_wild = total.filter("wild <> '' and wild <> mask or wild rlike '[a-z]'").groupBy("wild").agg((F.sum("edge") / F.count(F.lit(1))).alias("wild_edge"), F.approx_count_distinct("k0", 0.02).alias("files"))
    pages = lines.groupBy("k0").agg(F.count_distinct("k1").alias("pages"))
    by_file = edges.filter("mask <> '' and r <= 1").groupBy("k0", "side", "mask").agg(F.count_distinct("k1").alias("on"), F.sum(outer).alias("outer"))
    by_file = by_file.join(pages, "k0").join(by_mask, "mask")
    running = by_file.filter((F.col("on") >= 2) & (F.col("on") >= min_share * F.col("pages")) & (F.col("mask_edge") >= min_edge))
    running = written(running.select("k0", "side", "mask"), f"{root}/running")
    # at most ten a side of a page and rank: each stands on a tenth of the pages
    lists = running.groupBy("k0", "side").agg(F.sort_array(F.collect_set("mask")).alias("known"))

    @F.pandas_udf("boolean")
    def alike(masks: pd.Series, known: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for m, ks in zip(masks, known, strict=True):
            out.append(bool(m) and ks is not None and any(abs(len(k) - len(m)) <= 4 and (k == m or SequenceMatcher(None, k, m, autojunk=False).ratio() >= 0.82) for k in ks))
        return pd.Series(out)

    e = edges.join(lists, ["k0", "side"], "left").join(by_wild.filter((F.col("files") >= min_files) & (F.col("wild_edge") >= min_edge)).select("wild", F.lit(True).alias("usual")), "wild", "left")
    e = e.withColumn("hit", F.col("number") | alike("mask", "known") | F.coalesce("usual", F.lit(False)))
    inner = W.partitionBy("k0", "k1", "side").orderBy("r")
    e = e.withColumn("all_out", F.min(F.col("hit").cast("int")).over(inner))
    return e.filter("all_out = 1").select("k0", "k1", "line_no").distinct()


# --- suspect lines ----------------------------------------------------------------------------------------------------


def _unreadable(line: str) -> bool:
    """Whether most of a line is no words at all: symbols, codes, broken encoding, single letters."""
    ts = _TOKEN.findall(line)
    return sum(len(t) > 1 and sum(c.isalpha() and c.isascii() for c in t) >= 0.6 * len(t) and not re.search(r"\d.*\d|[^\W\d_][\d|][^\W\d_]*[\d|]", t) for t in ts) < 0.45 * len([t for t in ts if not t.strip(_EDGE_PUNCTUATION).isdigit()])


_MARKS = "line_no int, what string, word string, joined string, hyphened string, odd boolean, tail boolean, side string, r int, mask string, wild string, number boolean, near array<int>, w int, c int, n long"
_WINDOW = 3


def read_pages(pages: DataFrame, usual: list[str], model: list[str]) -> DataFrame:
    """What one pass over the pages (k0, k1, text) gathers, told apart by the column what.

    'edge': the first and last lines of every page that are not blank, and all other short lines without their place (side ''); 'word': words that
    are not usual or have odd glyphs, with the numbers of the model's words around them; 'cut': words cut at line ends; 'pair': counts n
    of neighbours w and c among the model's words, summed for a batch of pages.
    """
    sent = pages.sparkSession.sparkContext.broadcast((frozenset(usual), {w: i for i, w in enumerate(model)}))
    kinds = [pages.schema[k].dataType.simpleString() for k in ("k0", "k1")]
    names = ["k0", "k1", *(x.split()[0] for x in _MARKS.split(", "))]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, numbers = sent.value
        size = max(len(numbers), 1)

        def wild(mask: str) -> str:
            return " ".join(x if not (c := core(x)) or "#" in c or c in known else "*" for x in mask.split())

        for pdf in it:
            rows: list[tuple] = []
            ids: list[int] = []
            for k0, k1, t in pdf[["k0", "k1", "text"]].itertuples(index=False):
                lines = _lines(t)
                full = [i for i, x in enumerate(lines) if x.strip()]
                for r, i in enumerate(full):
                    back = len(full) - 1 - r
                    edges = [(s, e) for s, e in (("top", r), ("bottom", back)) if e < EDGE]
                    m = mask_line(lines[i]) if edges or len(lines[i].split()) <= 8 else ""
                    if edges:
                        number, w = bool(_PAGE_NUMBER.match(lines[i].strip())), wild(m)
                        rows += [(k0, k1, i + 1, "edge", None, None, None, None, None, s, e, m, w, number, None, None, None, None) for s, e in edges]
                    elif m:
                        rows.append((k0, k1, i + 1, "edge", None, None, None, None, None, "", 9, m, wild(m), False, None, None, None, None))
                body = [(i, x, core(x)) for i, x in _body_words(lines)]
                own = [numbers.get(w, -1) for _, _, w in body]
                ids += own
                ids += [-1] * _WINDOW
                odd_junk: dict[int, bool] = {}
                for j, (i, token, w) in enumerate(body):
                    if w in known and w.isalpha() and w.isascii():
                        continue
                    inner = token.strip(".,;:\"'()[]*").lower()
                    odd = odd_glyphs(inner)
                    if odd or (len(w) >= 3 and w[0].isalpha() and w not in known):
                        if i not in odd_junk:
                            odd_junk[i] = _unreadable(lines[i])
                        if not odd_junk[i]:
                            near = [x for x in own[max(0, j - _WINDOW) : j] + own[j + 1 : j + 1 + _WINDOW] if x >= 0]
                            rows.append((k0, k1, i + 1, "word", inner if odd else w, None, None, odd, False, None, None, None, None, None, near, None, None, None))
                printed = [i for i in full if not _PAGE_NUMBER.match(lines[i].strip())]
                for q, a in enumerate(printed):
                    last = _TOKEN.findall(lines[a])[-1]
                    if last[-1] in BREAKS and len(last) > 1 and last[-2].isalnum():
                        left = core(last[:-1].lstrip("([\"'"))
                        nxt = core(_TOKEN.findall(lines[printed[q + 1]])[0]) if q + 1 < len(printed) else ""
                        if left and left[-1].isalpha() and not (nxt and nxt[0].isdigit()):
                            rows.append((k0, k1, a + 1, "cut", left, left + nxt, f"{left}-{nxt}" if nxt else None, last[-1] != "-", q >= len(printed) - 3, None, None, None, None, None, None, None, None, None))
            a = np.array(ids, dtype=np.int64)
            keys = [a[:-d][ok] * size + a[d:][ok] for d in range(1, _WINDOW + 1) if len(ok := (a[:-d] >= 0) & (a[d:] >= 0)) and ok.any()]
            if rows:
                yield pd.DataFrame(rows, columns=names)
            if keys:
                u, n = np.unique(np.concatenate(keys), return_counts=True)
                out = pd.DataFrame({x: None for x in names}, index=range(len(u)))
                yield out.assign(what="pair", w=(u // size).astype(np.int32), c=(u % size).astype(np.int32), n=n)

    return pages.mapInPandas(run, f"k0 {kinds[0]}, k1 {kinds[1]}, {_MARKS}")


def _analyse(pages: DataFrame, file: str, page: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The distinct pages (k0, k1, text), their furniture and cut lines (k0, k1, line_no), and misread words (with word and target)."""
    spark: SparkSession = pages.sparkSession
    root = scratch_dir(spark)
    src = pages.select(F.col(file).alias("k0"), F.col(page).alias("k1"), F.col(text).alias("text")).filter("k0 is not null and k1 is not null and text rlike '\\\\S'").distinct()
    src = written(src, f"{root}/pages")
    counts = written(word_counts(src, "text"), f"{root}/counts")
    links = written(glyph_links(counts), f"{root}/links")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # by their shares these are at most 500,000 and 20,000 words
    usual = counts.filter((F.col("n") >= 20) & (F.col("n") >= USUAL_SHARE * total)).join(links.select("word").distinct(), "word", "left_anti")
    usual = sorted(((r["word"], r["n"]) for r in usual.collect()), key=lambda x: (-x[1], x[0]))
    model = [(w, n) for w, n in usual if n >= MODEL_SHARE * total]
    marks = written(read_pages(src, [w for w, _ in usual], [w for w, _ in model]), f"{root}/marks")
    of = lambda what: marks.filter(F.col("what") == what)
    pair = of("pair").select("w", "c", "n")
    vectors = skip_grams(pair.unionByName(pair.select(F.col("c").alias("w"), F.col("w").alias("c"), "n")), model)
    out = written(furniture(of("edge").select("k0", "k1", "line_no", "side", "r", "mask", "wild", "number"), root), f"{root}/furniture")
    body = lambda what: of(what).join(out, ["k0", "k1", "line_no"], "left_anti")
    n = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    cut = body("cut").select("k0", "k1", "line_no", "word", "joined", "hyphened", "odd", "tail")
    cut = cut.join(n("joined"), "joined", "left").join(n("hyphened"), "hyphened", "left").fillna(0, ["n_joined", "n_hyphened"])
    # near the end of a page the rest may stand on the next one: there a hyphen belongs to what often is the first half of a word
    halves = counts.filter("word like '%-%'").groupBy(F.substring_index("word", "-", 1).alias("word")).agg(F.sum("n").alias("n_first"))
    cut = cut.join(halves, "word", "left").fillna(0, ["n_first"])
    belongs = "tail and not odd and n_joined = 0 and n_hyphened = 0 and length(word) >= 4 and n_first >= 20"
    hyphen = cut.filter(f"(n_joined >= n_hyphened or (odd and n_hyphened < 3)) and not ({belongs})").select("k0", "k1", "line_no").distinct()
    words = print_of(body("word").select("k0", "k1", "line_no", "word", "odd", "near"), links, vectors)
    # a word with odd glyphs counts if it is mostly letters, as names are whose print is known from nowhere
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    misread = words.filter(F.col("target").isNotNull() | (F.col("odd") & (letters >= 3) & (letters >= F.length("word") - F.when(letters >= 5, 2).otherwise(1))))
    hyphen = written(hyphen, f"{root}/hyphen")
    misread = written(misread.select("k0", "k1", "line_no", "word", "target").distinct(), f"{root}/misread")
    keep_only(spark, root, "pages", "furniture", "hyphen", "misread")
    return src, out, hyphen, misread


def line_kinds(pages: DataFrame, file: str, page: str, text: str) -> DataFrame:
    """(file, page, line_no, kind): lines that are 'furniture', end in a cut word ('hyphen') or hold a misread word ('misread').

    Lines are split at '\\n' and counted from 1, blank ones included. Defined results: null and blank texts give no rows;
    repeated pages count once; null files or pages are left out; a file of one page has furniture only by what other files
    show; no pages give an empty table; other columns are ignored.
    """
    _, out, hyphen, misread = _analyse(pages, file, page, text)
    kind = lambda df, k: df.select("k0", "k1", "line_no", F.lit(k).alias("kind"))
    lines = kind(out, "furniture").unionByName(kind(hyphen, "hyphen")).unionByName(kind(misread, "misread"))
    return lines.distinct().select(F.col("k0").alias(file), F.col("k1").alias(page), "line_no", "kind")


def reflow(text: str, furniture: set[int], cut: set[int], fixes: dict[int, dict[str, str]]) -> str:
    """Text without furniture lines, with cut words joined and misread words replaced, one line a paragraph.

    A paragraph ends at a blank line, before an indented line, and around lines of a list, table or form.
    """
    paragraphs: list[str] = []
    now, glue = "", False

    def close() -> None:
        nonlocal now, glue
        if now:
            paragraphs.append(now)
        now, glue = "", False

    lines = _lines(text)
    for i, raw in enumerate(lines):
        if i + 1 in furniture:
            continue
        line = raw.strip()
        if not line:
            if not glue:
                close()
            continue
        if fix := fixes.get(i + 1):
            line = re.sub(r"\S+", lambda m: _replace(m[0], fix), line)  # noqa: B023
        listed = bool(_LISTED.match(line))
        if (raw[:3] == "   " or listed) and not glue:
            close()
        joined = i + 1 in cut
        body = line[:-1] if joined else line.replace("\xad", "")
        now = now + body if glue else f"{now} {body}".strip()
        glue = joined
        if listed:
            close()
    close()
    return "\n\n".join(paragraphs)


_LISTED = re.compile(r"^(?:[*•·▪◦–—-]\s|\(?\w{1,3}[.)]\s|\||TAB \w+:|[A-Z ./]{3,30}:\s)|.*(?:\S {3,}\S|;.*;|\t)")


def _replace(token: str, fix: dict[str, str]) -> str:
    """A token with its misread word replaced, in the case of the token."""
    for w in (core(token), token.strip(".,;:\"'()[]*").lower()):
        if target := fix.get(w):
            at = token.lower().find(w)
            if at >= 0:
                t = target.upper() if token.isupper() and len(token) > 1 else target.capitalize() if token[at : at + 1].isupper() else target
                return token[:at] + t + token[at + len(w) :]
    return token


def repair_pages(pages: DataFrame, file: str, page: str, text: str) -> DataFrame:
    """(file, page, repaired): each page as continuous paragraphs, separated by blank lines; see line_kinds() for what counts once.

    Words with odd glyphs whose print is known from nowhere stay as they are.
    """
    src, out, hyphen, misread = _analyse(pages, file, page, text)
    keys = ["k0", "k1"]
    # what is gathered per page is bounded by its own lines
    f = out.groupBy(*keys).agg(F.collect_list("line_no").alias("furniture"))
    h = hyphen.groupBy(*keys).agg(F.collect_list("line_no").alias("cut"))
    m = misread.filter("target is not null").groupBy(*keys).agg(F.collect_list(F.struct("line_no", "word", "target")).alias("fixes"))

    @F.pandas_udf("string")
    def mend(t: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        res = []
        for x, fs, hs, ms in zip(t, a, b, c, strict=True):
            by: dict[int, dict[str, str]] = {}
            for r in ms if ms is not None else ():
                by.setdefault(r["line_no"], {})[r["word"]] = r["target"]
            res.append(reflow(x, set(fs if fs is not None else ()), set(hs if hs is not None else ()), by))
        return pd.Series(res, dtype=object)

    j = src.join(f, keys, "left").join(h, keys, "left").join(m, keys, "left")
    return j.select(F.col("k0").alias(file), F.col("k1").alias(page), mend("text", "furniture", "cut", "fixes").alias("repaired"))


def pages_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, text): the parts of page-marked texts; a text without marks is page 1."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n--- PAGE (?=\d{1,9} ---\n)")
    whole = files.filter(f"{key} is not null and {text} is not null").select(F.col(key), F.posexplode(parts).alias("i", "part"))
    number = F.when(F.col("i") > 0, F.regexp_extract("part", r"^(\d{1,9}) ---\n", 1).cast("int")).otherwise(1)
    body = F.when(F.col("i") > 0, F.regexp_replace("part", r"^\d{1,9} ---\n", "")).otherwise(F.substring("part", 2, 2147483647))
    return whole.select(key, number.alias("page_number"), body.alias("text"), "i").filter("i > 0 or trim(text) <> ''").drop("i")
