"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings source_files page_results "
    "source_records incidents event_members canonical_events entities eval_items region_zones split_limits mix_targets"
).split()


def build_session(app: str = "evidex", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution); conf overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_rows(df: DataFrame, most: int) -> list:
    """All rows of a table that is small at every scale; an error, not a cut, if it holds more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table that was to hold at most {most} rows holds more")
    return rows


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for written intermediate tables.

    It lies in the shared folder of spark.checkpoint.dir, so that a lost executor loses nothing. Only a session on one
    machine (a local master) may do without; on a cluster a missing shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "evidex-scratch")
    return f"{root.rstrip('/')}/evidex-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch_dir()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep_only(spark: SparkSession, path: str, *names: str) -> None:
    """Delete all tables under a folder of scratch_dir() but the named ones, which a lazy result still reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        for s in fs.listStatus(p):
            if s.getPath().getName() not in names:
                fs.delete(s.getPath(), True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df stored at path and read back: a lineage cut that survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
