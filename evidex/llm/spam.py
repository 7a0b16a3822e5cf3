"""Keyword-stuffed pages and link lists: mutual information of neighbouring words and repeated collocations.

1. Every text is brought to word ids once (zero-width characters dropped, compatibility forms and digits used as letters
   folded, tags of words and links taken apart, their first words marked) and the ids are written.
2. Words and pairs of neighbouring words are counted exactly over the whole corpus. The shares of those that make up at least
   COMMON_SHARE of all are sent to the tasks: at most 1 / COMMON_SHARE each, however large the corpus. What occurs once needs no
   sending, and the counts of the rest are joined, so every share is exact.
3. Each document gets the mean pointwise mutual information of its neighbouring words and the share of its words that stand in
   excessively repeated collocations: pairs with a high information that, over the corpus, occur several times in each text that has
   them at all; where that figure is lower, this text must repeat them itself.
4. Links and tags are units that make collocations too: their words count where one unit follows another within a few words, and
   that as often in the text as a pair of words must be repeated. A single link in prose counts nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import scratch_dir, written

_WORD = re.compile(r"[^\W_]+")
_SPECIAL = re.compile(r"((?:https?:)?//[^\s<>\"'\])]+|www\.[^\s<>\"'\])]+|\[[^\[\]\n]{1,300}\](?=\())|(#[^\W_]\w*|\bsku\W{0,3}\d+[^\n\r$€£*/|;]{0,80})|(<[^<>]{0,300}>)", re.IGNORECASE)
_PRODUCT = re.compile(r"\bsku\b", re.IGNORECASE)
_HREF = re.compile(r"(?:https?:)?//[^\s<>\"']+")
_CAMEL = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
# Digits and signs used as letters, and Cyrillic and Greek letters that look Latin.
_LEET = str.maketrans("013457", "oieast")
_LOOKALIKE = str.maketrans("авекмнорстухіјѕαορετικνυ", "abekmhopctyxijsaopetikvu")
_ORDINAL = re.compile(r"\d+(st|nd|rd|th|d|s|h|am|pm|px|mm|km|v|x)?$|[a-z]\d+$")
#: Words and pairs of at least this share of all have their share known to the tasks.
COMMON_SHARE = 1e-6
#: The bit of a mark that says that a link or tag begins.
BEGINS = 4
#: The id of numbers, which break a collocation.
NUMBER = 0


class _Ids(dict):
    """Word to id; a word is brought to its letters when it is first seen."""

    def __missing__(self, w: str) -> int:
        if w.isdecimal() or (not w.isalpha() and _ORDINAL.match(w)):
            v = NUMBER
        else:
            if not w.isalpha():
                w = w.translate(_LEET)
            v = max(zlib.crc32(w.encode()), 1)
        if len(self) < 2_000_000:  # only the cache is limited
            self[w] = v
        return v


def word_ids(text: str, ids: dict[str, int]) -> tuple[list[int], list[int] | None]:
    """Ids of the words of a text, and for each 1 in a link, 2 in a tag, else 0 (None: all 0); the first word of a link or tag has the bit BEGINS too."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
        if re.search("[Ͱ-ӿ]", text) and re.search("[a-z]", text):
            text = text.lower().translate(_LOOKALIKE)
    if "//" not in text and "#" not in text and "<" not in text and "www." not in text and not _PRODUCT.search(text):
        return [ids[w] for w in _WORD.findall(text.lower())], None
    out: list[int] = []
    mark: list[int] = []

    def put(part: str, m: int) -> None:
        ws = _WORD.findall(part.lower())
        out.extend(ids[w] for w in ws)
        mark.extend([m | BEGINS if m else 0, *[m] * (len(ws) - 1)] if ws else ())

    at, anchor = 0, 0
    for m in _SPECIAL.finditer(text):
        put(text[at : m.start()], anchor)
        at = m.end()
        if m[1]:
            put(m[1], 1)
        elif m[2]:
            put(" ".join(_CAMEL.findall(m[2])), 2)
        else:
            if m[3][:2].lower() in ("<a", "</"):  # the text of a link belongs to it
                anchor = int(m[3][2:3].isspace())
            for h in _HREF.findall(m[3]):
                put(h, 1)
    put(text[at:], 0)
    return out, mark


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, marks): the texts as arrays of word ids (uint32) and marks (uint8, empty if there are none), in binary."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    kind = src.schema["key"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for pdf in it:
            words, marks = [], []
            for t in pdf["text"]:
                w, m = word_ids(t, ids)
                words.append(np.array(w, dtype=np.uint32).tobytes())
                marks.append(bytes(m) if m and any(m) else b"")
            yield pd.DataFrame({"key": pdf["key"], "words": words, "marks": marks})

    return src.mapInPandas(run, f"key {kind}, words binary, marks binary")


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch and the row of each."""
    arrays = [np.frombuffer(b, dtype=np.uint32) for b in pdf["words"]]
    n = np.array([len(a) for a in arrays], dtype=np.int64)
    return (np.concatenate(arrays) if arrays else np.empty(0, np.uint32)), np.repeat(np.arange(len(arrays)), n)


def _hashes(w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions i whose words i and i + 1 are neighbours in one text and no numbers, and the hash of each pair."""
    at = np.flatnonzero((row[1:] == row[:-1]) & (w[1:] != NUMBER) & (w[:-1] != NUMBER))
    h = w[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w[at + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return at, h.view(np.int64)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _per_text(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct pairs of each text, and the place among them of every pair."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])][: len(x)]
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return r[first], x[first], np.diff(np.r_[first, len(x)]), place


_RANGE = 1 << 14


class Shares:
    """Logarithms (base 2) of the shares of common things, by their hashes; others have that of a thing that occurs once."""

    def __init__(self, hashes: np.ndarray, shares: np.ndarray, rare: float):
        order = np.argsort(hashes)
        self.hashes, self.logs, self.rare = hashes[order], np.log2(shares[order]).astype(np.float32), np.float32(np.log2(rare))

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.logs[at], self.rare)


def corpus_shares(encoded: DataFrame, least: float = COMMON_SHARE) -> tuple[tuple[Shares, Shares], DataFrame, tuple[int, int]]:
    """Shares of words and of neighbouring pairs among all, counted exactly and kept from the share `least` on; the counts (kind, h, n) of all; both totals.

    Batches are summed before they are shuffled; what reaches the driver is at most 1 / least words and as many pairs.
    """

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            w, row = _flat(pdf)
            _, h = _hashes(w, row)
            for kind, x in ((0, w[w != NUMBER].astype(np.int64)), (1, h)):
                u, n = np.unique(x, return_counts=True)
                yield pd.DataFrame({"kind": np.full(len(u), kind, np.int8), "h": u, "n": n})

    sums = encoded.select("words").mapInPandas(partial, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    sums = written(sums, f"{scratch_dir(encoded.sparkSession)}/sums")
    total = {r["kind"]: r["n"] for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    out = []
    totals = tuple(max(total.get(kind, 0), 1) for kind in (0, 1))
    for kind, all_ in enumerate(totals):
        got = sums.filter((F.col("kind") == kind) & (F.col("n") >= least * all_)).select("h", "n").toPandas()
        out.append(Shares(got["h"].to_numpy(np.int64), got["n"].to_numpy(float) / all_, 1 / all_))
    return (out[0], out[1]), sums, totals


def rare_parts(encoded: DataFrame, sums: DataFrame, common: Broadcast, totals: tuple[int, int], least: float) -> DataFrame:
    """(row, rare): what the sum of information of a text has to gain over that with Shares alone, by the counts of words and pairs that occur more than once but have none there."""
    rare = sums.filter((F.col("n") > 1) & (F.col("n") < F.when(F.col("kind") == 0, least * totals[0]).otherwise(least * totals[1]))).select("kind", "h", F.log2("n").alias("gain"))

    def rest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of, pairs_of = common.value
        for pdf in it:
            w, row = _flat(pdf)
            at, h = _hashes(w, row)
            ends = np.r_[at, at + 1]
            for kind, of, x, r, sign in ((0, words_of, w[ends].astype(np.int64), row[ends], -1), (1, pairs_of, h, row[at], 1)):
                new = ~of.has(x)
                r, x, n, _ = _per_text(r[new], x[new])
                yield pd.DataFrame({"row": pdf["row"].to_numpy()[r], "kind": np.full(len(x), kind, np.int8), "h": x, "m": (sign * n).astype(np.int32)})

    parts = encoded.select("row", "words").mapInPandas(rest, "row long, kind byte, h long, m int").join(rare, ["kind", "h"])
    return parts.groupBy("row").agg(F.sum(F.col("m") * F.col("gain")).alias("rare"))


def _bitmap(hashes: DataFrame, bits: int = 24) -> np.ndarray:
    """Which of 2^bits buckets hold a hash (column h): an array of a fixed size."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(_RANGE, dtype=bool)
        a[pdf["b"].to_numpy() % _RANGE] = True
        return pd.DataFrame({"r": [int(pdf["b"].iloc[0]) // _RANGE], "a": [np.packbits(a).tobytes()]})

    buckets = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("b")).distinct()
    out = np.zeros(1 << bits, dtype=bool)
    for x in buckets.groupBy(F.floor(F.col("b") / _RANGE)).applyInPandas(pack, "r long, a binary").collect():
        out[x.r * _RANGE : (x.r + 1) * _RANGE] = np.unpackbits(np.frombuffer(x.a, np.uint8)).astype(bool)
    return out


def burst_pairs(encoded: DataFrame, root: str, least: float, bits: int = 24) -> DataFrame:
    """(h, burst, p, a, b): pairs of words a and b, by hash, p in number, with (count + 1) / (documents + 1) of at least `least`, counted exactly; a logarithm to the base 2.

    Such a pair stands that often in some text. Those pairs alone are counted, picked by a bitmap of a fixed size; others
    that share their buckets are counted too, and left out by their own counts.
    """
    need = max(1, math.ceil(least))

    def repeated(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            w, row = _flat(pdf)
            at, h = _hashes(w, row)
            _, x, n, _ = _per_text(row[at], h)
            yield pd.DataFrame({"h": np.unique(x[n >= need])})

    sent = encoded.sparkSession.sparkContext.broadcast(_bitmap(encoded.select("words").mapInPandas(repeated, "h long"), bits))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            w, row = _flat(pdf)
            at, h = _hashes(w, row)
            known = sent.value[_top(h, bits)]
            _, x, n, _ = _per_text(row[at][known], h[known])
            u, inv = np.unique(x, return_inverse=True)
            at = at[known][np.unique(h[known], return_index=True)[1]]
            yield pd.DataFrame({"h": u, "a": w[at].astype(np.int64), "b": w[at + 1].astype(np.int64), "p": np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64), "d": np.bincount(inv, minlength=len(u))})

    sums = encoded.select("words").mapInPandas(count, "h long, a long, b long, p long, d long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("d").alias("d"), F.min("a").alias("a"), F.min("b").alias("b"))
    return written(sums.select("h", "p", "a", "b", (F.log2(F.col("p") + 1) - F.log2(F.col("d") + 1)).alias("burst")).filter(F.col("burst") >= math.log2(least) - 1e-9), f"{root}/burst")


def _listed(mark: np.ndarray, row: np.ndarray, k: int, near: int, min_repeats: int) -> np.ndarray:
    """Words of links and tags of which another begins within `near` words before or after, min_repeats times or more in the text."""
    begins = np.flatnonzero(mark & BEGINS)
    out = np.zeros(len(mark), dtype=bool)
    if len(begins) < 2:
        return out
    plain = np.cumsum(mark == 0)  # words outside of links and tags so far
    close = (row[begins[1:]] == row[begins[:-1]]) & (plain[begins[1:]] - plain[begins[:-1]] <= near)
    often = np.bincount(row[begins[1:]][close], minlength=k) >= min_repeats
    unit = (np.r_[close, False] | np.r_[False, close]) & often[row[begins]]
    of = np.cumsum((mark & BEGINS) > 0) - 1  # the unit that a marked word belongs to
    marked = np.flatnonzero(mark > 0)
    out[marked] = unit[of[marked]]
    return out


def page_scores(df: DataFrame, key: str, text: str, least: float = COMMON_SHARE, near: int = 5, min_repeats: int = 3, min_burst: float = 2.5, sure_burst: float = 3.0, min_information: float = 3.0) -> DataFrame:
    """(key, words, mean_information, repeated_share, link_share, tag_share, spam_share) for every text that is not null.

    Numbers count neither as words nor as neighbours. spam_share is the share of words in links, tags or repeated
    collocations together; mean_information is null without neighbouring words. Defined results: an empty text has 0
    words and shares of 0; repeated rows get the same figures each; a null key is kept; an empty table gives an empty
    table; other columns are ignored. Texts are read whole.
    """
    spark = df.sparkSession
    root = scratch_dir(spark)
    encoded = written(encode(df, key, text).withColumn("row", F.monotonically_increasing_id()), f"{root}/words")
    bursts = burst_pairs(encoded, root, min(min_burst, sure_burst))
    sent = spark.sparkContext.broadcast(_bitmap(bursts))
    shares, sums, totals = corpus_shares(encoded, least)
    common = spark.sparkContext.broadcast(shares)  # at most 2 / least entries of 12 bytes
    words = sums.filter("kind = 0")
    for c in ("a", "b"):
        bursts = bursts.join(words.select(F.col("h").alias(c), F.col("n").alias(f"n{c}")), c)
    bursts = bursts.select("h", "burst", (F.log2(F.col("p") / totals[1]) - F.log2(F.col("na") / totals[0]) - F.log2(F.col("nb") / totals[0])).alias("info"))
    kind = encoded.schema["key"].dataType.simpleString()

    def held(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            w, row = _flat(pdf)
            at, h = _hashes(w, row)
            known = sent.value[_top(h, 24)]
            r, x, _, _ = _per_text(row[at][known], h[known])
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[r], "h": x})

    mine = encoded.select("row", "words").mapInPandas(held, "row long, h long").join(bursts, "h").groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("h", "burst", "info")))  # the distinct pairs of one text

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of, pairs_of = common.value
        for pdf in it:
            k = len(pdf)
            w, row = _flat(pdf)
            real = w != NUMBER
            mark = np.frombuffer(b"".join(m if m else bytes(len(x) // 4) for m, x in zip(pdf["marks"], pdf["words"], strict=True)), dtype=np.uint8)
            at, h = _hashes(w, row)
            u = words_of.of(w.astype(np.int64))
            info = pairs_of.of(h) - u[at] - u[at + 1]
            _, _, n, inv = _per_text(row[at], h)
            some = lambda x: np.concatenate([np.asarray(v) for v in pdf[x] if v is not None] or [np.empty(0)])  # noqa: B023, E731
            known, first = np.unique(some("h").astype(np.int64), return_index=True)
            burst, exact = np.full(len(h), -np.inf), np.full(len(h), -np.inf)
            if len(known):
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ok = known[spot] == h
                burst[ok], exact[ok] = some("burst")[first][spot[ok]], some("info")[first][spot[ok]]
            hot = (((n[inv] >= min_repeats) & (burst >= np.log2(min_burst) - 1e-9)) | (burst >= np.log2(sure_burst) - 1e-9)) & (exact >= min_information - 1e-9)
            rep = np.zeros(len(w), dtype=bool)
            rep[at[hot]] = rep[at[hot] + 1] = True
            listed = _listed(mark, row, k, near, min_repeats)
            kind = mark & (BEGINS - 1)
            sums = lambda x: np.bincount(row, weights=x, minlength=k) if len(row) else np.zeros(k)
            words = sums(real)
            share = lambda x: sums(x & real) / np.maximum(words, 1)
            pairs = np.bincount(row[at], minlength=k) if len(at) else np.zeros(k)
            rare = pdf["rare"].fillna(0).to_numpy(float) if "rare" in pdf else 0
            mean = (np.bincount(row[at], weights=info, minlength=k) + rare) / np.maximum(pairs, 1) if len(at) else np.zeros(k)
            yield pd.DataFrame({
                "key": pdf["key"], "words": words.astype(np.int64), "mean_information": np.where(pairs > 0, mean, np.nan),
                "repeated_share": share(rep), "link_share": share(listed & (kind == 1)), "tag_share": share(listed & (kind == 2)), "spam_share": share(rep | listed),
            })

    texts = encoded.join(mine, "row", "left")
    if least * max(totals) > 2:  # else all that occurs more than once is common
        texts = texts.join(rare_parts(encoded, sums, common, totals, least), "row", "left")
    out = texts.mapInPandas(score, f"key {kind}, words long, mean_information double, repeated_share double, link_share double, tag_share double, spam_share double")
    return out.withColumn("mean_information", F.expr("nullif(mean_information, double('NaN'))")).withColumnRenamed("key", key)


def flag_pages(scores: DataFrame, most_spam: float = 0.5, least_information: float = -1.0, min_words: int = 20) -> DataFrame:
    """scores with a column reason: 'repeated collocations', 'links', 'tags', 'word salad', or null for an ordinary text."""
    kinds = F.greatest("repeated_share", "link_share", "tag_share")
    why = F.when(F.col("link_share") == kinds, "links").when(F.col("tag_share") == kinds, "tags").otherwise("repeated collocations")
    salad = (F.col("mean_information") < least_information) & (F.col("words") >= min_words)
    return scores.withColumn("reason", F.when(F.col("spam_share") > most_spam, why).when(salad, "word salad"))
