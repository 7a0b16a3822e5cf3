"""Held-out passages inside a corpus: an FM-index per shard, searched backwards for the phrases of every passage.

A shard is a block of documents of bounded size. Its text, as word ids, gets a full suffix array (prefix doubling in
numpy), the Burrows-Wheeler transform with a wavelet matrix for ranks, and suffix positions sampled at every few words.
Each phrase of a few words of the passages is searched backwards; its occurrences are located by walking
to the next sampled position. Documents with a phrase of a passage are then aligned with it word by word, unless the words
that match beside the phrases are too few: matched runs are stretched over single changed words, and their spans are merged.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{0,300}>")
_CUT = re.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
# Glyphs and pairs of glyphs that scanners take for one another, each brought to one of them.
_GLYPH_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"))
_GLYPHS = str.maketrans("01i|58e6h", "olllsbcbb")


def fold_word(w: str) -> str:
    """A lower-case word without accents, with glyphs that are easily misread brought together."""
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    for a, b in _GLYPH_PAIRS:
        w = w.replace(a, b)
    return w.translate(_GLYPHS)


def text_words(text: str) -> list[str]:
    """Lower-case words of a text without mark-up; words cut at line ends are joined."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(_INVISIBLE)
    if "-" in text and "\n" in text:
        text = _CUT.sub("", text)
    return _WORD.findall(text.lower())


class Vocabulary(dict):
    """Word as written to the id of its folded form; 1 for words outside the passages, 0 is the end of a document."""

    def __init__(self, folded: dict[str, int]):
        super().__init__()
        self.folded = folded

    def __missing__(self, w: str) -> int:
        v = self.folded.get(fold_word(w), 1)
        if len(self) < 1_000_000:  # only the cache is limited
            self[w] = v
        return v


class Passages:
    """The passages as word ids, the phrases to search for, and what doesn't count."""

    def __init__(self, items: list[tuple[int, str]], phrase: int = 4, notice_items: int = 3, notice_words: int = 10):
        words = {i: [fold_word(w) for w in text_words(p)] for i, p in items if p}
        self.phrase = phrase
        self.folded = {w: n for n, w in enumerate(sorted({w for ws in words.values() for w in ws}), 2)}
        self.ids = {i: np.array([self.folded[w] for w in ws], dtype=np.int64) for i, ws in sorted(words.items())}
        owners: dict[tuple, set[int]] = defaultdict(set)
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, a in self.ids.items():
            for k in range(len(a) - phrase + 1):
                g = tuple(a[k : k + phrase].tolist())
                owners[g].add(i)
                places[g].append((i, k))
        # a standing notice: a run of phrases that the same items share
        self.counts: dict[int, np.ndarray] = {}
        for i, a in self.ids.items():
            own_of = [owners[tuple(a[k : k + phrase].tolist())] for k in range(len(a) - phrase + 1)]
            ok, k = np.ones(len(a), dtype=bool), 0
            while k < len(own_of):
                e, same = k, own_of[k]
                while e < len(own_of) and len(same & own_of[e]) >= notice_items:
                    same = same & own_of[e]
                    e += 1
                if e - k + phrase - 1 >= notice_words:
                    ok[k : e + phrase - 1] = False
                k = max(e, k + 1)
            self.counts[i] = ok
        self.items = list(self.ids)
        self.length = np.array([len(a) for a in self.ids.values()], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length  # of each item in flat
        self.flat = np.concatenate([*self.ids.values(), np.empty(0, np.int64)])
        self.flat_counts = np.concatenate([*self.counts.values(), np.empty(0, bool)])
        # every phrase, also of notices and of several items: a run can begin in any of them
        no = {i: n for n, i in enumerate(self.items)}
        all_ = sorted(places.items())
        self.patterns = np.array([g for g, _ in all_], dtype=np.int64).reshape(-1, phrase)
        size = np.array([len(p) for _, p in all_], dtype=np.int64)
        self.place_start, self.place_size = np.cumsum(size) - size, size
        self.place_item = np.array([no[i] for _, p in all_ for i, _ in p], dtype=np.int64)
        self.place_at = np.array([k for _, p in all_ for _, k in p], dtype=np.int64)


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the range of each member, and the members, one range after the other."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of word ids by prefix doubling; ends of documents (0) differ from each other by their place."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    r = text.astype(np.int64) + len(ends)
    r[ends] = np.arange(len(ends))
    bits = max(1, int(r.max()).bit_length())
    h = max(1, min(4, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for j in range(h):
        key <<= bits
        key[: n - j] |= r[j:]
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    head = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))  # slots of groups of more than one
    while len(open_):
        at = sa[open_]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        head = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~(head & np.r_[head[1:], True])]
        h *= 2
    return sa


class FMIndex:
    """Burrows-Wheeler transform of one block with a wavelet matrix and sampled suffix positions."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        sa = suffix_array(text)
        self.n, self.sample = len(text), sample
        bwt = text[sa - 1]
        self.bwt = bwt
        self.bits = max(1, int(text.max()).bit_length())
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=1 << self.bits))]
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []  # of ones before each place, by level
        a = bwt
        for level in range(self.bits - 1, -1, -1):
            one = (a >> level) & 1
            self.ranks.append(np.r_[0, np.cumsum(one)].astype(np.int32))
            self.zeros.append(int(len(a) - self.ranks[-1][-1]))
            a = np.r_[a[one == 0], a[one == 1]]
        self.base = np.zeros(1 << self.bits, dtype=np.int64)
        self.base = self._descend(np.arange(1 << self.bits), np.zeros(1 << self.bits, dtype=np.int64))
        # starts of documents are sampled too: ends differ by place, so no step leads across one
        marked = (sa % sample == 0) | (bwt == 0)
        self.mark_rank = np.r_[0, np.cumsum(marked)].astype(np.int32)
        self.samples = sa[marked].astype(np.int32)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, z) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            r = ones[i].astype(np.int64)
            i = np.where((c >> (self.bits - 1 - level)) & 1, z + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i places of the transform hold c."""
        return self._descend(c, i) - self.base[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [from, to) of the suffixes that start with each pattern (a row of ids)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = (patterns < (1 << self.bits)).all(axis=1)
        hi[~live] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            k = np.flatnonzero(lo < hi)
            c = patterns[k, j]
            lo[k], hi[k] = self.starts[c] + self.rank(c, lo[k]), self.starts[c] + self.rank(c, hi[k])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes by their rows: steps back to the next sampled place."""
        out = np.empty(len(rows), dtype=np.int64)
        at, ids, steps = rows.copy(), np.arange(len(rows)), 0
        while len(ids):
            got = self.mark_rank[at + 1] > self.mark_rank[at]
            out[ids[got]] = self.samples[self.mark_rank[at[got]]] + steps
            at, ids = at[~got], ids[~got]
            c = self.bwt[at]
            at = self.starts[c] + self.rank(c, at)
            steps += 1
        return out


def matched_words(doc: np.ndarray, passage: np.ndarray, counts: np.ndarray, phrase: int = 4, min_run: int = 6) -> tuple[int, list[tuple[int, int]]]:
    """How many words of the passage that count are repeated by the document in runs of min_run words, and the merged spans of the document."""
    places: dict[tuple, list[int]] = defaultdict(list)
    p, d = passage.tolist(), doc.tolist()
    for k in range(len(p) - phrase + 1):
        places[tuple(p[k : k + phrase])].append(k)
    covered, done, spans = np.zeros(len(p), dtype=bool), set(), []

    def stretch(i: int, j: int, step: int) -> int:
        """Words matched from (i, j) on; a single changed word is passed if two matches follow."""
        n = 0
        while True:
            a, b = i + n * step, j + n * step
            ok = lambda x: 0 <= a + x * step < len(d) and 0 <= b + x * step < len(p) and d[a + x * step] == p[b + x * step]  # noqa: B023, E731
            if ok(0):
                n += 1
            elif ok(1) and ok(2):
                n += 3
            else:
                return n

    for i in range(len(d) - phrase + 1):
        for j in places.get(tuple(d[i : i + phrase]), ()):
            if (i, j) in done:
                continue
            back, on = stretch(i - 1, j - 1, -1), stretch(i, j, 1)
            done.update((i + x, j + x) for x in range(-back, on))
            if back + on >= min_run:
                covered[j - back : j + on] = True
                spans.append((i - back, i + on))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return int((covered & counts).sum()), merged


def long_runs(docs: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, known: Passages, item: np.ndarray, place: np.ndarray, min_run: int = 6) -> np.ndarray:
    """Whether matched_words makes a run of min_run words from each phrase (at in docs, within [begin, end), and at place in item)."""
    start, size = known.start[item], known.length[item]

    def side(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        n = np.zeros(len(a), dtype=np.int64)
        live, need = np.arange(len(a)), min_run - known.phrase

        def same(x: int) -> np.ndarray:
            i, j = a[live] + (n[live] + x) * step, b[live] + (n[live] + x) * step
            ok = (i >= begin[live]) & (i < end[live]) & (j >= 0) & (j < size[live])
            return ok & (docs[np.where(ok, i, 0)] == known.flat[start[live] + np.where(ok, j, 0)])

        while len(live):
            more = np.where(same(0), 1, np.where(same(1) & same(2), 3, 0))
            n[live] += more
            live = live[(more > 0) & (n[live] < need)]
        return n

    return known.phrase + side(at - 1, place - 1, -1) + side(at + known.phrase, place + known.phrase, 1) >= min_run


def most_words(docs: np.ndarray, ends: np.ndarray, known: Passages, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int, int]]:
    """(doc, item, words) of each pair of a document and an item: no alignment counts more than these words.

    docs: the words of all documents, which end at ends. The rows are sorted and say that item, moved by shift words, shares a run with doc. A run keeps its shift,
    and each of its words is a match at that shift or stands next to one. About `most` words are compared at once.
    """
    begins = np.r_[0, ends[:-1]]
    parts = lambda size: np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)])
    tail = np.r_[head[1:], len(doc)]
    for pairs in np.split(np.arange(len(head)), parts(known.length[item[head]])):
        if not len(pairs):
            continue
        size = known.length[item[head[pairs]]]
        start = np.cumsum(size) - size
        covered = np.zeros(int(size.sum()), dtype=bool)
        pair, rows = spread(head[pairs], tail[pairs] - head[pairs])
        for s in np.split(np.arange(len(rows)), parts(known.length[item[rows]])):
            of, j = spread(np.zeros(len(s), dtype=np.int64), known.length[item[rows[s]]])
            r = rows[s][of]
            i = j + shift[r] + begins[doc[r]]
            inside = (i >= begins[doc[r]]) & (i < ends[doc[r]])
            x = np.flatnonzero(inside & (docs[np.where(inside, i, 0)] == known.flat[known.start[item[r]] + j]))
            for step in (-1, 0, 1):
                y = x[(j[x] + step >= 0) & (j[x] + step < known.length[item[r[x]]])]
                covered[start[pair[s[of[y]]]] + j[y] + step] = True
        _, at = spread(known.start[item[head[pairs]]], size)
        words = np.add.reduceat((covered & known.flat_counts[at]).astype(np.int64), start)
        yield from zip(doc[head[pairs]].tolist(), item[head[pairs]].tolist(), words.tolist(), strict=True)


def find_leaks(docs: DataFrame, key: str, text: str, items: list[tuple[int, str]], min_share: float = 1 / 3, block_words: int = 1 << 20) -> DataFrame:
    """(key, item_id, share, words, spans): documents that repeat at least min_share of the words of an item's passage.

    items: the stated set of held-out passages, searched against every document; it is sent to all tasks. share is of the
    passage's words in matched runs of at least six words, standing notices left out; spans are the merged word ranges
    of the document. Every document and item that share a run are aligned, unless the words that match at the runs' shifts are too few for min_share.
    Defined results: null texts, keys and passages, and texts or passages shorter than a
    phrase, match nothing; repeated rows give repeated results; no items or no documents give an empty table; long texts
    are searched whole (a text longer than a block is a block of its own); other columns are ignored.
    """
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    kind = src.schema["key"].dataType.simpleString()
    sent = src.sparkSession.sparkContext.broadcast(Passages([(int(i), p) for i, p in items if p]))
    columns = ["key", "item_id", "share", "words", "spans"]

    def search(keys: list, ids: list[np.ndarray], known: Passages) -> pd.DataFrame:
        rows: list[tuple] = []
        # words outside the passages are no part of any phrase: a run of them is one word of the index
        parts, n_words, places = [], [], []
        for a in ids:
            keep = (a != 1) | np.r_[True, a[:-1] != 1]
            parts += [a[keep], [0]]
            places += [np.flatnonzero(keep), [len(a)]]
            n_words.append(int(keep.sum()) + 1)
        flat = np.concatenate(parts).astype(np.int64)
        ends = np.cumsum(n_words)
        written_at = np.concatenate(places).astype(np.int64)  # place of each word of the index in its document
        fm = FMIndex(flat)
        lo, hi = fm.search(known.patterns)
        n = hi - lo
        if n.sum():
            which = np.repeat(np.arange(len(n)), n)
            at = fm.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
            doc = np.searchsorted(ends, at, side="right")
            at = written_at[at]
            span = int(known.length.max()) + max(len(a) for a in ids)
            found = np.empty(0, dtype=np.int64)
            words_of = np.cumsum([len(a) for a in ids])
            flat = np.concatenate(ids)
            for x in np.array_split(np.arange(len(at)), 1 + int(known.place_size[which].sum()) // 1_000_000):
                of, place = spread(known.place_start[which[x]], known.place_size[which[x]])
                of, item, place = x[of], known.place_item[place], known.place_at[place]
                end = words_of[doc[of]]
                begin = end - np.array([len(a) for a in ids])[doc[of]]
                ok = long_runs(flat, begin, end, begin + at[of], known, item, place)
                shift = at[of[ok]] - place[ok] + int(known.length.max())
                found = np.union1d(found, (doc[of[ok]] * len(known.items) + item[ok]) * span + shift)
            pair, shift = found // span, found % span - int(known.length.max())
            for r, n_item, most in most_words(flat, words_of, known, pair // len(known.items), pair % len(known.items), shift):
                item = known.items[n_item]
                p = known.ids[item]
                if most < min_share * len(p):
                    continue
                words, spans = matched_words(ids[r], p, known.counts[item], known.phrase)
                if words >= min_share * len(p):
                    rows.append((keys[r], item, words / len(p), words, [{"a": a, "b": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=columns)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        if not len(known.patterns):
            return
        vocabulary = Vocabulary(known.folded)
        keys, ids, size = [], [], 0
        for pdf in it:
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                a = np.array([vocabulary[w] for w in text_words(t)], dtype=np.int64)
                if len(a) < known.phrase:
                    continue
                if keys and (size + len(a) > block_words or len(keys) >= 10_000):
                    if len(found := search(keys, ids, known)):
                        yield found
                    keys, ids, size = [], [], 0
                keys.append(k)
                ids.append(a)
                size += len(a)
        if keys and len(found := search(keys, ids, known)):
            yield found

    out = src.mapInPandas(run, f"key {kind}, item_id long, share double, words long, spans array<struct<a:long,b:long>>")
    return out.withColumnRenamed("key", key)
