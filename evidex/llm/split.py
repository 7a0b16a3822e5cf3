"""Splitting oversized texts and files into overlapping pieces that end at natural boundaries.

A text is cut into ranges. The worker of a range sees it with a halo on both sides, detects the page, paragraph,
sentence and word ends in it, and cuts the stretch between the anchors of its two borders. The anchor of a border is the
best boundary in the last window before it; both neighbours see that window whole, so they agree on it without talking.
Lengths and piece counts of the ranges are then added up in order (prefix sums), which gives every piece its offset and
number. No Python worker ever holds more than one range of a giant text or file with its halos.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.session import scratch_dir, written

#: Boundaries from the strongest to the weakest; a match ends where a piece may end.
BOUNDARIES = {
    "page": re.compile(r"\n(?=--- PAGE \d{1,9} ---\n)"),
    "paragraph": re.compile(r"\n[ \t\r]{0,64}\n\s{0,64}"),
    "sentence": re.compile(r"[.!?…][\"'”’)\]]{0,3}\s{1,64}"),
    "word": re.compile(r"\s{1,64}"),
}
#: Characters beyond a window that a boundary pattern can see.
CONTEXT = 256
PIECE_SCHEMA = "range_no long, range_chars long, k int, body_from long, piece_from long, piece_to long, cut string, piece string"


def best_cut(text: str, lo: int, hi: int) -> tuple[int, str]:
    """The strongest boundary in (lo, hi], the last of its kind, at best in the upper half; hi ('hard') where there is none."""
    if hi >= len(text):
        return len(text), "end"
    for low in ((lo + hi) // 2, lo):
        for kind, p in BOUNDARIES.items():
            best = -1
            for m in p.finditer(text, max(low - 8, 0), min(len(text), hi + CONTEXT)):
                if low < m.end() <= hi:
                    best = m.end()
                elif m.end() > hi:
                    # a run of white space over the limit may end inside it
                    if kind == "word" and low < hi and m.start() < hi:
                        best = hi
                    break
            if best > 0:
                return best, kind
    return hi, "hard"


def cut_stretch(text: str, at: int, end: int, limit: int, overlap: int, first: bool) -> list[tuple[int, int, int, str]]:
    """Pieces (body start, piece start, piece end, kind of cut) of text[at:end], each of at most limit characters."""
    out = []
    overlap = min(overlap, limit // 2)
    while at < end:
        start = at
        if not (first and not out) and overlap:
            start = max(at - overlap, 0)
            m = BOUNDARIES["word"].search(text, start, at)
            if m and start and not text[start - 1].isspace() and m.end() < at:
                start = m.end()
        hi = start + limit
        if end <= hi:
            stop, kind = end, "end"
        else:
            stop, kind = best_cut(text[: end + CONTEXT], at, hi)
        out.append((at, start, stop, kind))
        at = stop
    return out


def _halo(limit: int, overlap: int) -> int:
    return limit + overlap + CONTEXT


def cut_range(left: str, own: str, right: str, limit: int, overlap: int) -> list[tuple[int, int, int, str, str]]:
    """Pieces of one range as (body start, piece start, piece end, kind, text), offsets from the start of own (may be negative).

    left and right are the halos, empty at the ends of the text.
    """
    window = max(limit - min(overlap, limit // 2), 1)
    text = left + own + right
    s, e = len(left), len(left) + len(own)
    a = best_cut(text[: s + CONTEXT], max(s - window, 0), s)[0] if left else 0
    b, kind = best_cut(text, max(e - window, 0), e) if right else (e, "end")
    a = min(a, b)
    parts = cut_stretch(text, a, b, limit, overlap, first=not left)
    if parts and right:
        parts[-1] = (*parts[-1][:3], kind)
    return [(x - s, y - s, z - s, how, text[y:z]) for x, y, z, how in parts]


def _edge(b: bytes, i: int) -> int:
    """The first start of a character at or after byte i."""
    i = max(0, min(i, len(b)))
    while i < len(b) and b[i] & 0xC0 == 0x80:
        i += 1
    return i


def _cut_bytes(raw: bytes, start: int, at: int, end: int, total: int, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int, str, str]]]:
    """Characters and pieces of the range of bytes [at, end) of a text of total bytes; raw are its bytes from start on, halos included."""
    a, b = _edge(raw, at - start), _edge(raw, end - start) if end < total else len(raw)
    left, own, right = (x.decode("utf-8", "replace") for x in (raw[_edge(raw, 0) if start else 0 : a], raw[a:b], raw[b:]))
    return len(own), cut_range(left, own, right, limit, overlap)


_COLUMNS = ["range_no", "range_chars", "k", "body_from", "piece_from", "piece_to", "cut", "piece"]


def _entries(key: tuple, r: int, chars: int, pieces: list[tuple[int, int, int, str, str]]) -> list[tuple]:
    """Rows of one range: its entry in the boundary table (k = -1), and its pieces with offsets from its own start."""
    return [(*key, r, chars, -1, 0, 0, 0, "", ""), *((*key, r, chars, k, x, y, z, how, piece) for k, (x, y, z, how, piece) in enumerate(pieces))]


def _stitched(cut: DataFrame, text: list[str]) -> DataFrame:
    """Pieces of all ranges with their numbers and offsets in the whole text: prefix sums over the boundary table, which has one row of numbers a range."""
    table = cut.filter("k = -1").select(*text, "range_no", "range_chars")
    counts = cut.filter("k >= 0").groupBy(*text, "range_no").agg(F.count(F.lit(1)).alias("c"))
    table = table.join(counts, [*text, "range_no"], "left").fillna(0, ["c"])
    before = W.partitionBy(*text).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    base = table.select(*text, "range_no", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("range_chars", "base"), ("c", "done"))))
    return cut.filter("k >= 0").join(base, [*text, "range_no"])


def split_texts(df: DataFrame, key: str, text: str, limit: str, overlap: str, range_bytes: int = 1 << 15) -> DataFrame:
    """Pieces of a text column: (key, piece_no, piece_from, piece_to, body_from, cut, piece), offsets in code points from 0.

    limit and overlap are columns; a piece has at most limit characters, with what it repeats of the piece before
    (body_from is where its new text starts). Pieces cover the whole text and end at page, paragraph, sentence or word
    ends where one lies within the limit.

    Texts are cut into ranges of range_bytes (four bytes a character of the limit at least) with halos by Catalyst, on their UTF-8 bytes; the ranges of a text of
    several are spread over the cluster, so no Python worker holds a whole one, and their boundary tables are stitched by prefix sums.

    Defined results: a null limit (or below 1) means no limit and gives one piece; a null text gives no row, an empty text
    none; a null or negative overlap is 0, one over half the limit is cut to half; repeated rows repeat their pieces with
    the same numbers; other columns are not carried along.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("b"), F.col(limit).cast("long").alias("lim"), F.col(overlap).cast("long").alias("ov")).filter("b is not null and octet_length(b) > 0")
    src = src.select("key", "b", F.octet_length("b").alias("n"), F.expr("if(lim >= 1, least(lim, octet_length(b)), octet_length(b))").cast("int").alias("lim"), F.expr("greatest(coalesce(ov, 0), 0)").cast("int").alias("ov"))
    # 64-bit arithmetic: a halo is four bytes a character of a limit, an overlap and the context of a pattern
    src = src.withColumn("size", F.expr(f"least(greatest({range_bytes}L, 4L * lim), n)").cast("int")).withColumn("halo", F.expr(f"least(4L * (lim + least(ov, lim) + {CONTEXT}L), n)").cast("int")).withColumn("row", F.monotonically_increasing_id())
    ranges = src.select("key", "row", "n", "lim", "ov", "size", "halo", "b", F.explode(F.expr("sequence(0, cast((n - 1) div size as int))")).alias("range_no"))
    ranges = ranges.withColumn("at", F.expr("range_no * size")).withColumn("start", F.expr("greatest(at - halo, 0)"))
    ranges = ranges.withColumn("raw", F.expr("substring(b, start + 1, cast(least(0L + at + size + halo, n) - start as int))")).select("key", "row", "n", "lim", "ov", "size", "range_no", "at", "start", "raw")
    kind = src.schema["key"].dataType.simpleString()

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, row, n, lim, ov, size, r, at, start, raw in pdf.itertuples(index=False):
                rows += _entries((k, row), r, *_cut_bytes(raw, start, at, at + size, n, lim, ov))
            yield pd.DataFrame(rows, columns=["key", "row", *_COLUMNS])

    schema = f"key {kind}, row long, {PIECE_SCHEMA}"
    whole = ranges.filter("n <= size").mapInPandas(cut, schema).filter("k >= 0").withColumns({"base": F.lit(0).cast("long"), "done": F.lit(0).cast("long")})
    # a text of several ranges: one shuffle spreads them, and what they gave is written, to be read for the table and for the pieces
    several = ranges.filter("n > size").repartition("row", "range_no").mapInPandas(cut, schema)
    several = _stitched(written(several, f"{scratch_dir(spark)}/cut"), ["key", "row"])
    out = whole.unionByName(several.select(whole.columns))
    return out.select(F.col("key").alias(key), (F.col("done") + F.col("k") + 1).alias("piece_no"), *((F.col("base") + F.col(c)).alias(c) for c in ("piece_from", "piece_to", "body_from")), "cut", "piece")


def split_files(spark: SparkSession, files: DataFrame, limit: int, overlap: int = 0, range_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of UTF-8 files read by byte ranges: (path, piece_no, piece_from, piece_to, body_from, cut, piece).

    files: (path, bytes), paths or URIs. Each task opens its file at its own ranges, so a file of any size is spread over the
    cluster; ranges are made by Spark, not on the driver. Defined results: an empty file gives no row; broken bytes at any place are read as
    U+FFFD; a file listed twice is cut once.
    """
    size = max(range_bytes, 4 * limit)
    h = 4 * _halo(limit, overlap)
    listed = files.select("path", F.col("bytes").cast("long").alias("bytes")).filter("bytes > 0").distinct()
    ranges = listed.select("path", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {size}L)")).alias("range_no")).repartition("path", "range_no")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in it:
            for path, total, r in pdf.itertuples(index=False):
                store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                at = r * size
                lo, hi = max(at - h, 0), min(at + size + h, total)
                with store.open_input_file(name) as f:
                    f.seek(lo)
                    raw = f.read(hi - lo)
                yield pd.DataFrame(_entries((path,), r, *_cut_bytes(raw, lo, at, at + size, total, limit, overlap)), columns=["path", *_COLUMNS])

    cut = written(ranges.mapInPandas(read, f"path string, {PIECE_SCHEMA}"), f"{scratch_dir(spark)}/cut")
    out = _stitched(cut, ["path"])
    return out.select("path", (F.col("done") + F.col("k") + 1).alias("piece_no"), *((F.col("base") + F.col(c)).alias(c) for c in ("piece_from", "piece_to", "body_from")), "cut", "piece")
