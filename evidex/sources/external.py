"""What touches the outside world, with the call handed in: fetching, page extraction, model answers, providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page with fewer characters of native text is read by OCR.
NATIVE_LEAST = 100


class Providers:
    """Providers of records by name; a name without an implementation is known but not usable."""

    def __init__(self, **readers: Callable[..., DataFrame] | None):
        self.readers = readers

    def status(self) -> list[tuple[str, str]]:
        return sorted((n, "ready" if r else "not implemented") for n, r in self.readers.items())

    def read(self, name: str, *args: object) -> DataFrame:
        if name not in self.readers:
            raise KeyError(f"unknown provider {name}")
        if self.readers[name] is None:
            raise NotImplementedError(name)
        return self.readers[name](*args)


def fetch(df: DataFrame, url: str, get: Callable[[str, int], bytes | None], wait: Callable[[float], None], attempts: int = 6, first: float = 1.5, longest: float = 30.0) -> DataFrame:
    """(url, attempts, bytes) for every distinct url: get(url, attempt) until it gives bytes, with waits that double up to the longest.

    bytes is null where all attempts failed; get and wait are handed in and run on the workers.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for u in pdf["url"]:
                body, pause = None, first
                for n in range(1, attempts + 1):
                    body = get(u, n)
                    if body is not None or n == attempts:
                        break
                    wait(min(pause, longest))
                    pause *= 2
                rows.append((u, n, body))
            yield pd.DataFrame(rows, columns=["url", "attempts", "bytes"])

    return df.select(df[url].alias("url")).filter("url is not null").distinct().mapInPandas(run, "url string, attempts int, bytes binary")


def extract_pages(df: DataFrame, key: str, content: str, native: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str], least: int = NATIVE_LEAST) -> DataFrame:
    """(key, page, text, method) of binary documents: native text page by page, OCR where that is too short; an unreadable document gives no page."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, b in zip(pdf["key"], pdf["content"], strict=True):
                for n, text in enumerate(native(bytes(b)), 1):
                    if len(text) >= least:
                        rows.append((k, n, text, "native"))
                    else:
                        rows.append((k, n, ocr(bytes(b), n) or text, "ocr"))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "page", "text", "method"])

    src = df.select(df[key].alias("key"), df[content].alias("content")).filter("key is not null and content is not null")
    return src.mapInPandas(run, f"key {src.schema['key'].dataType.simpleString()}, page int, text string, method string").withColumnRenamed("key", key)


def answer_or_abstain(ask: Callable[[str, list[str]], list[str]], question: str, allowed: set[str]) -> tuple[str, int]:
    """('answered' | 'repaired' | 'abstained', calls): an answer that cites anything else than what is allowed is asked for once more, told what was wrong."""
    wrong = [c for c in ask(question, []) if c not in allowed]
    if not wrong:
        return "answered", 1
    return ("repaired", 2) if all(c in allowed for c in ask(question, wrong)) else ("abstained", 2)


class Busy(Exception):
    """What a call raises when it is to be made again later."""


def embed(df: DataFrame, id_: str, text: str, call: Callable[[list[str], int], list[list[float]]], dims: int, stored: int, wait: Callable[[float], None], batch: int = 128, most: int = 8000, tries: int = 5) -> DataFrame:
    """(id, vector, attempts): texts sent to an embedding model in batches, one vector each, padded with zeros to the stored length.

    A text is cut to `most` characters, the model's limit. call(texts, attempt) may raise Busy: it is made again after a
    pause that doubles, up to `tries` times; then, and for a vector of another length than dims, the task fails. Null texts are left out.
    """
    src = df.select(F.col(id_).alias("id"), F.substring(text, 1, most).alias("text")).filter("text is not null")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for attempt in range(tries):
                    try:
                        got = call(part["text"].tolist(), attempt)
                        break
                    except Busy:
                        wait(5.0 * 2**attempt)
                else:
                    raise RuntimeError(f"the model was busy {tries} times")
                if len(got) != len(part) or any(len(v) != dims for v in got):
                    raise RuntimeError(f"the model was to give {len(part)} vectors of {dims} numbers")
                yield pd.DataFrame({"id": part["id"], "vector": [[*v, *[0.0] * (stored - dims)] for v in got], "attempts": attempt + 1})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, vector array<float>, attempts int").withColumnRenamed("id", id_)


def look_up(df: DataFrame, key: str, find: Callable[[str], float | None], wait: Callable[[float], None], pause: float = 1.1) -> DataFrame:
    """(key, found) for every distinct key that is not null: one call each, with a pause between the calls of a task; None where nothing is found."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = []
            for k in pdf["key"]:
                if found:
                    wait(pause)
                found.append(find(k))
            yield pd.DataFrame({"key": pdf["key"], "found": pd.Series(found, dtype=float)})

    src = df.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    out = src.mapInPandas(run, "key string, found double")
    return out.select(F.col("key").alias(key), F.expr("nullif(found, double('NaN'))").alias("found"))


def ocr_plan(pages: DataFrame, kind: str, size: str, thumbnail: int = 20_000) -> DataFrame:
    """pages with decision: 'keep_native', 'failed' (nothing to read), 'skip_thumbnail' (an image file under so many bytes) or 'ocr'.

    The stored metrics are the quality gate: a page that was found good, is of a file that has no scans, or has printable, wordy text stays.
    """
    none = (F.coalesce("char_count", F.lit(0)) == 0) & (F.coalesce("native_char_count", F.lit(0)) == 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    good = (F.coalesce("printable_ratio", F.lit(0.0)) >= 0.85) & (F.coalesce("alpha_ratio", F.lit(0.0)) >= 0.45) & (F.coalesce("word_count", F.lit(0)) >= 15)
    d = F.when(F.col("final_category") == "native_good", "keep_native").when(~F.col(kind).isin("pdf", "image"), "keep_native").when(none, "failed")
    return pages.withColumn("decision", d.when((F.col(kind) == "image") & (F.col(size) < thumbnail), "skip_thumbnail").when(good, "keep_native").otherwise("ocr"))


def paged_scan(spark: SparkSession, get: Callable[[int, int], list[dict]], schema: str, size: int = 1000, readers: int = 8) -> DataFrame:
    """All rows of a source that is read page by page: get(start, size) gives up to size rows from start on, fewer at the end.

    Reader r of n takes the pages r, r + n, r + 2n, ... until one is short, so a source is read by several tasks at once without asking for its
    length first. A page that fails raises, and its task is run again from the reader's first page.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf["id"]:
                at = int(r) * size
                while True:
                    rows = get(at, size)
                    if rows:
                        yield pd.DataFrame(rows, columns=names)
                    if len(rows) < size:
                        break
                    at += readers * size

    return spark.range(0, readers, 1, readers).mapInPandas(run, schema)


def write_atomically(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written beside its place and renamed over it: a reader sees the old content or the new, never half or none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    p, tmp = hadoop.Path(path), hadoop.Path(path + ".part")
    out = p.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(content))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(p.getFileSystem(conf).getUri(), conf).rename(tmp, p, how)
