"""Joins of the archive beyond a plain equi-join: cascades, coverage, token overlap, duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.text import fold_excerpt, ratio, tokens
from evidex.session import keep_only, scratch_dir, written


def cascade(left: DataFrame, right: DataFrame, id_l: str, id_r: str, keys: list[tuple[str, Column, Column]]) -> DataFrame:
    """(left id, right id, level, candidates): each left row joined on the first key that finds anything.

    keys: (level, expression on left, expression on right); blank keys find nothing. A level that finds several right rows
    is reported with their number and no right id: an ambiguous match is never made.
    """
    frames = []
    for i, (level, a, b) in enumerate(keys):
        x = left.select(F.col(id_l).alias("__l"), a.alias("__k")).filter("__k is not null and __k <> ''")
        y = right.select(F.col(id_r).alias("__r"), b.alias("__k")).filter("__k is not null and __k <> ''").distinct()
        frames.append(x.join(y, "__k").select("__l", "__r", F.lit(i).alias("__i"), F.lit(level).alias("level")))
    hits = reduce(DataFrame.unionByName, frames)
    per = hits.groupBy("__l", "__i", "level").agg(F.count_distinct("__r").alias("candidates"), F.min("__r").alias("__r"))
    best = per.groupBy("__l").agg(F.min_by(F.struct("level", "candidates", "__r"), "__i").alias("b"))
    out = best.select("__l", "b.level", "b.candidates", F.when(F.col("b.candidates") == 1, F.col("b.__r")).alias("__r"))
    full = left.select(F.col(id_l).alias("__l")).distinct().join(out, "__l", "left")
    return full.select(F.col("__l").alias(id_l), F.col("__r").alias(id_r), F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def reconcile(left: DataFrame, right: DataFrame, id_l: str, id_r: str, position: str, keys: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """(left id, right id, level, candidates): 1:1 matches by the keys in order; each right row serves the first left row (by position) that claims it.

    keys: (level, expression on left, expression on right, mode). A left row takes the right row of the first key that settles it: with
    mode 'free' the only one that no earlier left row took, with 'unique' one that has its key for itself and is free. It is 'ambiguous' and takes none
    where several are free ('free'), or several have the key ('unique'). 'last' is 'unique', but ambiguous only where several are free. What one pass in
    order of the positions gives, decided round by round: a row is decided when no undecided row before it shares a candidate
    with it, so the rounds are as many as the longest chain of rows that wait for each other. Blank keys find nothing; positions are distinct.
    """
    spark, root = left.sparkSession, scratch_dir(left.sparkSession)
    frames = []
    for i, (level, a, b, mode) in enumerate(keys):
        x = left.select(F.col(id_l).alias("l"), F.col(position).alias("p"), a.alias("k")).filter("k is not null and k <> ''").distinct()
        y = right.select(F.col(id_r).alias("r"), b.alias("k")).filter("k is not null and k <> ''").distinct()
        y = y.join(y.groupBy("k").agg(F.count(F.lit(1)).alias("total")), "k")
        if mode == "unique":  # a key of several rows needs none of them
            y = y.withColumn("r", F.when(F.col("total") == 1, F.col("r"))).distinct()
        frames.append(x.join(y, "k").select("l", "p", "r", "total", F.lit(i).alias("i"), F.lit(level).alias("level"), F.lit(mode).alias("mode")))
    hits = written(reduce(DataFrame.unionByName, frames), f"{root}/h0")
    done: DataFrame | None = None
    n = 0
    while not hits.isEmpty():
        turn = hits.filter("r is not null").groupBy("r").agg(F.min("p").alias("turn"))
        ready = hits.join(turn, "r", "left").groupBy("l").agg(F.bool_and(F.coalesce(F.col("p") == F.col("turn"), F.lit(True))).alias("ready")).filter("ready").select("l")
        per = hits.join(ready, "l").groupBy("l", "i", "level", "mode", "total").agg(F.count_distinct("r").alias("free"), F.min("r").alias("r"))
        found = (F.col("free") == 1) & ((F.col("mode") == "free") | (F.col("total") == 1))
        several = (F.col("free") > 1) | ((F.col("mode") == "unique") & (F.col("total") > 1))
        per = per.filter(found | several).select("l", "i", F.struct(F.when(found, F.col("level")).otherwise("ambiguous").alias("level"), F.greatest("free", F.when(F.col("mode") == "unique", F.col("total")).otherwise(0)).alias("candidates"), F.when(found, F.col("r")).alias("r")).alias("b"))
        best = per.groupBy("l").agg(F.min_by("b", "i").alias("b"))
        new = written(ready.join(best, "l", "left").select("l", "b.level", "b.candidates", "b.r"), f"{root}/d{n}")
        done = new if done is None else done.unionByName(new)
        n += 1
        hits = written(hits.join(new.select("l"), "l", "left_anti").join(new.filter("r is not null").select("r"), "r", "left_anti"), f"{root}/h{n}")
    full = left.select(F.col(id_l).alias("l")).distinct()
    if done is None:
        kind = dict(right.dtypes)[id_r]
        return full.select(F.col("l").alias(id_l), F.lit(None).cast(kind).alias(id_r), F.lit("none").alias("level"), F.lit(0).cast("long").alias("candidates"))
    keep_only(spark, root, *(f"d{i}" for i in range(n)))
    full = full.join(done, "l", "left")
    return full.select(F.col("l").alias(id_l), F.col("r").alias(id_r), F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def token_pairs(a: DataFrame, b: DataFrame, id_: str, text: str, least: int, stop: tuple[str, ...] = (), length: int = 2) -> DataFrame:
    """(a, b, shared) of rows whose texts share at least `least` distinct tokens.

    A row is indexed under its rarest tokens only: of n tokens, two rows that share `least` have one in common among the
    first n - least + 1 of each in one order of all tokens. Rows with fewer tokens than that pair with nothing.
    """
    x, y = (d.select(F.col(id_).alias("id"), tokens(text, length, stop).alias("all")).filter(F.size("all") >= least) for d in (a, b))
    count = x.select(F.explode("all").alias("t")).unionByName(y.select(F.explode("all").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def index(d: DataFrame, side: str) -> DataFrame:
        ranked = d.select("id", "all", F.explode("all").alias("t")).join(count, "t").groupBy("id", "all").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))  # the tokens of one text
        return ranked.select(F.col("id").alias(side), F.col("all").alias(f"all_{side}"), F.explode(F.slice("r", F.lit(1), F.size("r") - (least - 1))["t"]).alias("t"))

    pairs = index(x, "a").join(index(y, "b"), "t").select("a", "b", F.size(F.array_intersect("all_a", "all_b")).cast("long").alias("shared"))
    return pairs.filter(F.col("shared") >= least).distinct()


def same_event_pairs(words: DataFrame, long: int = 8) -> DataFrame:
    """(a, b), a < b: ids that share a word and whose years don't conflict; two without a year must share a word of at least `long` letters.

    words: (id, y, t), y '' where there is no year. Each of the three ways to be a pair has a join of its own, so that a short
    word that many rows without a year have joins none of them to each other.
    """
    dated, undated = words.filter("y <> ''"), words.filter("y = ''")
    telling = undated.filter(F.length("t") >= long)
    both = dated.toDF("a", "y", "t").join(dated.toDF("b", "y", "t"), ["y", "t"]).filter("a < b").select("a", "b")
    one = dated.toDF("a", "ya", "t").join(undated.toDF("b", "yb", "t"), "t").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    none = telling.toDF("a", "ya", "t").join(telling.toDF("b", "yb", "t"), "t").filter("a < b").select("a", "b")
    return both.unionByName(one).unionByName(none).distinct()


#: Texts of one group that make a block; a task compares two blocks.
BLOCK = 8000
_DIMS, _ROWS = 512, 512


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, which no matching of blocks exceeds."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike_in_blocks(a: list[str], b: list[str], one: bool, least: float, overlap: float) -> Iterator[tuple[int, int]]:
    """(i, j): the pairs of a and b (i < j if both are one block) whose lengths, words and letters allow the ratio `least` and the word overlap `overlap`.

    Words are counted by dimension, so the product of two rows is no less than the number of shared words; only where
    that is enough the words themselves are compared, and only then the letters in their order.
    """
    wa = [frozenset(t.split(" ")) for t in a]
    wb = wa if one else [frozenset(t.split(" ")) for t in b]
    na, nb, ma, mb = (np.array([len(x) for x in xs], np.float32) for xs in (a, b, wa, wb))

    def near() -> Iterator[tuple[int, int]]:
        if len(a) * len(b) <= 2000:
            yield from ((i, j) for i in range(len(a)) for j in range(i + 1 if one else 0, len(b)))
            return
        seen: dict[str, int] = {}
        dim = lambda ws: [seen.setdefault(w, len(seen)) % _DIMS for w in ws]

        def counts(words: list[frozenset[str]]) -> np.ndarray:
            m = np.zeros((len(words), _DIMS), np.float32)
            for i, ws in enumerate(words):
                np.add.at(m[i], dim(ws), 1)
            return m

        x = counts(wa)
        y = x if one else counts(wb)
        for at in range(0, len(a), _ROWS):
            low = at if one else 0
            rows = slice(at, at + _ROWS)
            enough = (x[rows] @ y[low:].T) * np.float32(1 + overlap) >= np.float32(overlap) * (ma[rows, None] + mb[None, low:]) - np.float32(0.01)
            for i, j in np.argwhere(enough):
                if not one or i + at < j + low:
                    yield int(i + at), int(j + low)

    for i, j in near():
        n = float(na[i] + nb[j])
        if 2 * min(na[i], nb[j]) / max(n, 1) >= least:
            same = len(wa[i] & wb[j])
            if same >= overlap * (len(wa[i]) + len(wb[j]) - same):
                s, t = a[i].lower(), b[j].lower()
                if 2 * common_letters(s, t) >= (least - 1e-6) * (len(s) + len(t)):  # ratios are rounded to six places
                    yield i, j


#: Bits of a text, classes of two neighbouring letters, pairs looked at in one go.
_MARKS, _TWOS, _PAIRS = 512, 1024, 8192
#: Bits for each of 32 classes of letters (the code modulo 32: blank, a to z, others), more for those that are more frequent in English.
_ROOM = [48, 26, 8, 13, 18, 40, 10, 10, 18, 24, 4, 6, 18, 12, 24, 24, 10, 4, 24, 24, 30, 13, 6, 8, 5, 8, 4, 2, 2, 2, 2, 2]


def _classes(texts: list[str], width: int, many: int) -> np.ndarray:
    """How often each of `many` classes of `width` (one or two) neighbouring letters is in each text, up to 127."""
    out = np.empty((len(texts), many), np.int8)
    for at in range(0, len(texts), 512):
        part = texts[at : at + 512]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        who = np.repeat(np.arange(len(part)), [len(t) for t in part])
        if width == 2:
            inside = who[:-1] == who[1:]
            codes, who = (codes[:-1] * 1031 + codes[1:] * 37)[inside], who[1:][inside]
        n = np.bincount(who * many + codes % many, minlength=len(part) * many)
        out[at : at + 512] = np.minimum(n, 127).reshape(-1, many)
    return out


def _marks(counts: np.ndarray) -> np.ndarray:
    """(words of bits, texts): the k-th letter of a class sets the k-th bit from where the class starts, after the last bit the first."""
    edge = np.zeros((len(counts), 2 * _MARKS + 1), np.int8)
    row = np.arange(len(counts))
    for c, at in enumerate(np.cumsum([0, *_ROOM[:-1]])):
        edge[:, at] += 1
        edge[row, at + counts[:, c]] -= 1
    run = np.cumsum(edge, axis=1, dtype=np.int8) > 0
    return np.ascontiguousarray(np.packbits(run[:, :_MARKS] | run[:, _MARKS:-1], axis=1).view(np.uint64).T)


def alike_by_letters(a: list[str], b: list[str], one: bool, least: float) -> Iterator[tuple[int, int]]:
    """(i, j): the pairs of a and b (i < j if both are one block) whose letters in their order allow the ratio `least`; no pair with that ratio is lost.

    Of two texts with n letters together at most u = (1 - least) * n have no partner. So the numbers of each letter differ by at
    most u in sum; and those of each two neighbouring letters by at most 3 u, for the letters with partners make at most u + 1 runs. Numbers of
    classes differ by no more than those of letters, and bits by no more than numbers. Only what is left is compared letter by letter.
    """
    a = [t.lower() for t in a]
    b = a if one else [t.lower() for t in b]
    spare = 1 - least + 1e-6  # ratios are rounded to six places

    def in_order(pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for i, j in pairs:
            n = len(a[i]) + len(b[j])
            if abs(len(a[i]) - len(b[j])) <= spare * n and n - 2 * common_letters(a[i], b[j]) <= spare * n:
                yield i, j

    if len(a) * len(b) <= 16:
        yield from in_order((i, j) for i in range(len(a)) for j in range(i + 1 if one else 0, len(b)))
        return
    # in order of lengths
    oa, ob = (np.argsort([len(t) for t in x], kind="stable") for x in (a, b))
    sa, sb = [a[i] for i in oa], [b[j] for j in ob]
    la, lb = (np.array([len(t) for t in x], np.float64) for x in (sa, sb))
    na = _classes(sa, 1, 32)
    nb = na if one else _classes(sb, 1, 32)

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(a) * len(b) <= _PAIRS:
            yield np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
            return
        xa = _marks(na)
        xb = xa if one else _marks(nb)
        shorter = (1 - spare) / (1 + spare)
        lows, highs = np.searchsorted(lb, la * shorter - 1), np.searchsorted(lb, la / shorter + 1)
        at = 0
        while at < len(a):
            low = max(int(lows[at]), at + 1 if one else 0)
            end = min(len(a), at + max(1, _PAIRS // max(int(highs[at]) - low, 1)))
            while end > at + 1 and (end - at) * (int(highs[end - 1]) - low) > 2 * _PAIRS:
                end = (at + end) // 2
            rows, cols = slice(at, end), slice(low, max(low, int(highs[end - 1])))
            unlike = np.bitwise_count(xa[:, rows, None] ^ xb[:, None, cols]).sum(0, dtype=np.uint16)
            i, j = np.nonzero(unlike <= spare * (la[rows, None] + lb[None, cols]))
            yield i + at, j + low
            at = end

    ta = tb = None
    for i, j in near():
        if one:
            i, j = i[i < j], j[i < j]
        fit = np.abs(na[i] - nb[j]).sum(1, dtype=np.int64) <= spare * (la[i] + lb[j])
        i, j = i[fit], j[fit]
        if len(i):
            if ta is None:
                ta = _classes(sa, 2, _TWOS)
                tb = ta if one else _classes(sb, 2, _TWOS)
            for k in range(0, len(i), 4096):
                p, q = i[k : k + 4096], j[k : k + 4096]
                fit = np.abs(ta[p] - tb[q]).sum(1, dtype=np.int64) <= 3 * spare * (la[p] + lb[q])
                pairs = zip(oa[p[fit]].tolist(), ob[q[fit]].tolist(), strict=True)
                yield from in_order((min(x), max(x)) if one else x for x in pairs)


def _near_in_blocks(texts: DataFrame, group: list[str], least: float, overlap: float, block: int) -> DataFrame:
    """(group, ka, kb, ta, tb): the pairs of alike_in_blocks() of each group, without an overlap those of alike_by_letters(), ka < kb.

    A group of at most `block` texts is compared as it is, many of them in one task. The texts of a larger one are dealt to
    blocks in order of their lengths, by a histogram of these; blocks whose lengths are too far apart don't meet.
    """
    spark, root = texts.sparkSession, scratch_dir(texts.sparkSession)
    src = texts.filter(" and ".join(f"{g} is not null" for g in group)).select(*group, "k", "t", F.length("t").alias("n"))
    per = src.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("start", F.sum("c").over(W.partitionBy(*group).orderBy("n")) - F.col("c")).withColumn("total", F.sum("c").over(W.partitionBy(*group)))
    # of groups larger than a block there are few
    per = written(per.filter(F.col("total") > block).drop("total"), f"{root}/lengths")
    spans = per.select(*group, "n", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("c") - 1) / block))).alias("b"))
    spans = spans.groupBy(*group, "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spans.select(*group, F.col("b").alias("y"), F.col("lo").alias("lo_y"))
    meet = spans.join(other, group).filter((F.col("b") <= F.col("y")) & ((F.col("hi") >= F.col("lo_y")) | (2 * F.col("hi") / (F.col("hi") + F.col("lo_y")) >= least)))
    meet = written(meet.select(*group, F.col("b").alias("x"), "y").withColumn("b", F.explode(F.array_distinct(F.array("x", "y")))), f"{root}/meet")
    dealt = src.join(per, [*group, "n"], "left").withColumn("b", F.coalesce(F.floor((F.col("start") + F.pmod(F.col("k"), F.col("c"))) / block), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    dealt = dealt.join(meet, [*group, "b"], "left").select(*group, zero("x"), zero("y"), "b", "k", "t")
    keys = [*group, "x", "y"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    kinds = dict(texts.dtypes)

    def compare(key: tuple, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        *g, x, y = key
        b = rows["b"].to_numpy()
        one = x == y
        (ks, ts), (ls, us) = ((rows["k"].to_numpy()[b == v], rows["t"].to_numpy()[b == v].tolist()) for v in (x, y))
        pairs = alike_in_blocks(ts, us, one, least, overlap) if overlap else alike_by_letters(ts, us, one, least)
        out = [(ks[i], ls[j], ts[i], us[j]) if ks[i] < ls[j] else (ls[j], ks[i], us[j], ts[i]) for i, j in pairs]
        if out:
            yield pd.DataFrame([(*g, *r) for r in out], columns=[*group, "ka", "kb", "ta", "tb"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for pdf in it:
            new = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            for at, end in zip(new, [*new[1:], len(pdf)], strict=True):
                key = tuple(pdf[keys].iloc[at])
                if key != now:
                    if parts:
                        yield from compare(now, parts)
                    now, parts = key, []
                parts.append(pdf.iloc[at:end])
        if parts:
            yield from compare(now, parts)

    return dealt.mapInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"ka {kinds['k']}, kb {kinds['k']}, ta string, tb string"]))


def _near_by_words(texts: DataFrame, group: list[str], least: float, overlap: float) -> DataFrame:
    """(group, ka, kb, ta, tb): pairs of a group with the word overlap whose lengths allow the ratio. Only keys are joined under words; texts are fetched for the pairs that are left."""
    words = texts.select(*group, "k", F.length("t").alias("n"), F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    count = words.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    ordered = words.join(count, "w").groupBy(*group, "k", "n").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("ws"))  # the words of one text
    size = F.size("ws")
    # a pair with Jaccard overlap o shares a word among the first n - ceil(o * n) + 1 of either in rarity order, and at least
    # o / (1 + o) of the two sizes together
    index = ordered.select(*group, "k", "n", size.alias("m"), F.explode(F.slice("ws", F.lit(1), (size - F.ceil(size * overlap) + 1).cast("int"))["w"]).alias("w"))
    side = lambda x: index.select(*group, "w", *(F.col(c).alias(f"{c}{x}") for c in ("k", "n", "m")))
    bound = 2 * F.least("na", "nb") / F.greatest(F.col("na") + F.col("nb"), F.lit(1)) >= least
    near = side("a").join(side("b"), [*group, "w"]).filter((F.col("ka") < F.col("kb")) & bound & (F.least("ma", "mb") >= overlap * F.greatest("ma", "mb")))
    near = near.select("ka", "kb").distinct()
    full = texts.select(*group, "k", "t", F.array_distinct(F.split("t", " ")).alias("all"))
    both = near.join(full.select(*group, F.col("k").alias("ka"), F.col("t").alias("ta"), F.col("all").alias("wa")), "ka").join(full.select(F.col("k").alias("kb"), F.col("t").alias("tb"), F.col("all").alias("wb")), "kb")
    same = F.size(F.array_intersect("wa", "wb"))
    return both.filter(same >= overlap * (F.size("wa") + F.size("wb") - same)).select(*group, "ka", "kb", "ta", "tb")


def similar_texts(texts: DataFrame, group: list[str], least: float, overlap: float = 0.3, block: int | None = None) -> DataFrame:
    """(group, ka, kb, ta, tb, ab, ba): pairs of distinct texts (columns of the group, k, t; k names a text) of one group with a ratio of at least `least` in one of the two orders.

    ab is the ratio of (ta, tb), ba that of (tb, ta). Texts must share, of their distinct words, at least `overlap` of the
    union (0.3 admits a changed letter in about every second word); no pair with that is lost. They meet under one of their rarest words
    (prefix filtering), which suits names and titles. Sentences share so many words that pairs which meet are a large part of all: with
    `block`, the texts of each group are compared in blocks of that size instead, and no pair is written before it is known to be near.
    With an overlap of 0, which needs a block, the ratio alone decides, and no pair that has it is lost.
    """
    if not (overlap or block):
        raise ValueError("texts that need share no words are compared in blocks")
    both = _near_in_blocks(texts, group, least, overlap, block) if block else _near_by_words(texts, group, least, overlap)
    scored = both.select("*", F.round(ratio("ta", "tb"), 6).alias("ab"), F.round(ratio("tb", "ta"), 6).alias("ba"))
    return scored.filter((F.col("ab") >= least) | (F.col("ba") >= least))


def similar_in_group(df: DataFrame, id_: str, group: list[str], text: str, least: float, shortest: int = 1, overlap: float = 0.3, block: int | None = None) -> DataFrame:
    """(a, b, ratio), a < b: pairs of one group whose folded texts have at least the ratio `least`; see similar_texts() for the overlap and the block.

    Rows of one text are tied to the smallest id among them, which alone stands for the text in pairs with other texts.
    """
    d = df.select(F.col(id_).alias("id"), *group, fold_excerpt(text).alias("t")).filter(F.length("t") >= shortest).withColumn("k", F.xxhash64(*group, "t"))
    first = d.groupBy(*group, "k", "t").agg(F.min("id").alias("rep"))
    near = similar_texts(first.select(*group, "k", "t"), group, least, overlap, block)
    rep = lambda x: first.select(F.col("k").alias(f"k{x}"), F.col("rep").alias(x))
    other = near.join(rep("a"), "ka").join(rep("b"), "kb")
    swap = F.col("a") > F.col("b")
    other = other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("ba")).otherwise(F.col("ab")).alias("ratio")).filter(F.col("ratio") >= least)
    copies = d.join(first.select("k", "rep"), "k").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio"))
    return other.unionByName(copies).distinct()


def similar_across(df: DataFrame, id_: str, apart: str, text: str, least: float, shortest: int = 1, overlap: float = 0.3) -> DataFrame:
    """(a, b, ratio), a < b: pairs of rows of different values of the column `apart` (none null) whose folded texts have at least the ratio `least`.

    Rows with one text and one value are tied to the smallest id among them, and a text that several values have to its
    smallest id of all: each other value's row is paired with that one only.
    """
    d = df.select(F.col(id_).alias("id"), F.col(apart).alias("v"), fold_excerpt(text).alias("t")).filter((F.length("t") >= shortest) & F.col("v").isNotNull()).withColumn("k", F.xxhash64("t"))
    first = d.groupBy("k", "t", "v").agg(F.min("id").alias("rep"))
    heads = first.groupBy("k", "t").agg(F.min(F.struct("rep", "v")).alias("h"))
    near = similar_texts(heads.select("k", "t"), [], least, overlap)
    side = lambda x: heads.select(F.col("k").alias(f"k{x}"), F.col("h.rep").alias(x), F.col("h.v").alias(f"v{x}"))
    other = near.join(side("a"), "ka").join(side("b"), "kb").filter("va <> vb")
    swap = F.col("a") > F.col("b")
    other = other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("ba")).otherwise(F.col("ab")).alias("ratio")).filter(F.col("ratio") >= least)
    copies = first.join(heads.select("k", "h"), "k").filter("v <> h.v").select(F.col("h.rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("ratio"))
    return other.unionByName(copies).distinct()


def ladder(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, c in rules:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(default) if out is not None else F.lit(default)
