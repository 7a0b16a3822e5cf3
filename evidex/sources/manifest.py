"""Manifests and other inputs: CSV with aliased headers, JSON artefacts, releases, catalogs, page texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions import values as V
from evidex.operators.relational import first_per, precedence_union

# Headers of a manifest by the field they fill; the first that is there and not null counts.
HEADERS = {
    "release_date": ["Release Date"], "title": ["Title"], "type": ["Type"], "description": ["Description Blurb", "Description"], "agency": ["Agency"], "incident_date": ["Incident Date"],
    "incident_location": ["Incident Location"], "link": ["PDF | Image Link", "Link", "URL"], "video_id": ["DVIDS Video ID"], "video_pairing": ["Video Pairing"], "pdf_pairing": ["PDF Pairing"],
    "modal_image": ["Modal Image"], "alt_text": ["Image Alt Text"], "virin": ["Image VIRIN"], "video_title": ["Video Title"], "featured": ["Featured"], "redaction": ["Redaction"],
}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header, quoted commas, quotes and line ends; all columns text; a byte order mark is no part of a header."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE", encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def resolve_headers(df: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """df with the fields of headers, each the first of its aliases that is not null, squeezed; '' where none is there."""
    have = {" ".join(c.split()): c for c in df.columns}
    cols = []
    for field, aliases in (headers or HEADERS).items():
        found = [F.col(f"`{have[a]}`") for a in aliases if a in have]
        cols.append((T.squeeze(F.coalesce(*found)) if found else F.lit("")).alias(field))
    return df.select(*cols)


def manifest_records(df: DataFrame, provider: str, releases: dict[str, int]) -> DataFrame:
    """Source records of a manifest with resolved headers: ids, types, dates, releases by date (M/D/YY), and a sparse map of what else is there."""
    day = V.us_short_date("release_date")
    table = {k: str(v) for k, v in releases.items()}
    number = T.lookup(F.date_format(day, "M/d/yy"), table).cast("int")
    ext = T.external_id("title", "link")
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select(
        F.lit(provider).alias("provider"), T.identity(provider, ext, "title", "link").alias("identity_key"), T.source_type("type").alias("source_type"), ext.alias("external_id"),
        number.alias("release_number"), day.alias("release_date"), none("title").alias("title"), none("description").alias("description"), T.agency("agency").alias("agency"),
        none("agency").alias("agency_raw"), none("incident_date").alias("incident_date_hint"), none("incident_location").alias("incident_location_hint"), none("link").alias("original_url"),
        F.lit("active").alias("status"), V.sparse_map(["video_id", "video_title", "pdf_pairing", "video_pairing", "alt_text"]).alias("metadata"),
    )


def first_readable(spark: SparkSession, paths: list[str], mirror: str | None = None, use_mirror: bool = False) -> tuple[DataFrame, str]:
    """The manifest at the first path that exists, and that path; the mirror comes last and only if it is asked for; an error if none does."""
    for p in [*paths, *([mirror] if mirror and use_mirror else [])]:
        if bytes_at(spark, p) >= 0:
            return read_csv(spark, p), p
    raise FileNotFoundError(", ".join(paths))


def bytes_at(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder; -1 if there is none."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(hp).getLength() if fs.exists(hp) else -1


# File types by extension.
EXTENSIONS = {"pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image", "mp4": "video", "mov": "video", "mp3": "audio", "wav": "audio"}


def legacy_rows(df: DataFrame, url: str, title: str, agencies: list[tuple[str, str | None]]) -> DataFrame:
    """Rows of an older manifest: url, filename, file type by extension, agency by the first keyword; rows without a web address are dropped."""
    u = T.strip(url)
    ext = F.lower(F.regexp_extract(T.url_path(u), r"\.([A-Za-z0-9]+)$", 1))
    d = df.filter(F.coalesce(u.rlike("(?i)^https?://"), F.lit(False)))
    return d.select(u.alias("url"), F.regexp_extract(T.url_path(u), r"([^/]*)$", 1).alias("filename"), T.lookup(ext, EXTENSIONS, F.lit("other")).alias("file_type"), T.ordered_keyword(F.concat_ws(" ", title, u), agencies, "USG").alias("agency"))


def supplement(rows: DataFrame, more: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """rows and those of more whose key isn't among them."""
    extra = more if only is None else more.filter(only)
    return rows.unionByName(extra.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artefact; a missing file gives an empty table of the schema."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=False)


def releases(frames: list[tuple[str, DataFrame]], key: str, superseded: list[str] = (), file: str = "filename") -> DataFrame:
    """Fragments of several releases: an earlier release keeps a key, files that were superseded are left out, the release is filled in where missing."""
    tagged = []
    for name, f in frames:
        r = F.coalesce(F.col("release"), F.lit(name)) if "release" in f.columns else F.lit(name)
        f = f.withColumn("release", r).withColumn("__pos", F.xxhash64(*f.columns))
        tagged.append(f.filter(~F.coalesce(F.col(file).isin(*superseded), F.lit(False))) if superseded else f)
    return precedence_union(tagged, key, "__pos").drop("__pos")


def last_values(base: DataFrame, rerun: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """The last row of each key, with columns overridden by a rerun's last row where it has values."""
    one = first_per(base, [key], [F.col(position).desc()])
    two = first_per(rerun, [key], [F.col(position).desc()]).select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = one.join(two, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.drop(*(f"__{c}" for c in columns))


def last_map(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): of several maps the last that has a key."""
    u = reduce(DataFrame.unionByName, [f.select(key, value, F.lit(i).alias("__p")) for i, f in enumerate(frames)])
    return u.groupBy(key).agg(F.max_by(value, F.struct("__p", value)).alias(value))


def front_matter(df: DataFrame, text: str, name: str) -> DataFrame:
    """(name, page, meta, body) of Markdown texts: the lines between --- marks as a map, the page from them or else the file name."""
    t = F.coalesce(F.col(text), F.lit(""))
    head = F.regexp_extract(t, r"^---\r?\n([\s\S]*?)\r?\n---\r?\n", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":"))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))
    page = F.coalesce(T.first_group(F.try_element_at(meta, F.lit("page")), r"(\d+)"), T.first_group(name, r"(\d+)\D*$")).cast("int")
    return df.select(name, page.alias("page"), meta.alias("meta"), F.regexp_replace(t, r"^---\r?\n[\s\S]*?\r?\n---\r?\n", "").alias("body"))


def queue(df: DataFrame, condition: Column, order: list[Column | str], most: int) -> DataFrame:
    """The next rows to work on: those that meet a condition, in a total order."""
    return df.filter(condition).orderBy(*order).limit(most)
