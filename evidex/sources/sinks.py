"""Sinks: snapshots, keyed upserts, partition refreshes, reports and logs. Each writes whole tables through Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.values import fingerprint


def snapshot(df: DataFrame, root: str, day: str) -> DataFrame:
    """Write an immutable snapshot under root/snapshot_date=day and give its one-row manifest; a day written before is an error."""
    path = f"{root}/snapshot_date={day}"
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    each = back.select(fingerprint(back.columns).alias("h"))
    # an order-free digest of the rows: the same rows give the same digest however they were written
    return each.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.bit_xor(F.xxhash64("h")).cast("string"), 256).alias("digest")).select(F.lit(day).alias("snapshot_date"), "*")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rewrite the table at path with fresh rows in place of those with the same keys; a missing table is written anew.

    The new state is complete at path/v=N before anything points to it; the last complete version is the table.
    """
    from evidex.operators.relational import first_per, merge

    current = latest(spark, path)
    one = first_per(fresh, keys, [c for c in fresh.columns if c not in keys] or keys)
    new = one if current is None else merge(current, fresh, keys)
    v = 0 if current is None else version(spark, path) + 1
    new.write.mode("errorifexists").parquet(f"{path}/v={v}")
    return spark.read.schema(new.schema).parquet(f"{path}/v={v}")


def version(spark: SparkSession, path: str) -> int:
    """The last complete version at path; -1 without one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(found, default=-1)


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    v = version(spark, path)
    return None if v < 0 else spark.read.parquet(f"{path}/v={v}")


def refresh_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ledger(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV with a header and the fields in their order; other columns are left out."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report(frames: dict[str, DataFrame], root: str) -> list[str]:
    """One JSON folder a table."""
    for name, f in frames.items():
        f.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{name}")
    return sorted(frames)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new) of all values that differ: what an update would write, for a dry run."""
    j = before.select(key, *(F.col(c).cast("string").alias(f"o_{c}") for c in columns)).join(after.select(key, *(F.col(c).cast("string").alias(f"n_{c}") for c in columns)), key)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in columns))).alias("x")
    return j.select(key, cells).select(key, "x.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def checkpoint_part(spark: SparkSession, path: str, part: DataFrame) -> DataFrame:
    """The cumulative table at path with one more part, as a new whole version; readers see the last complete one."""
    done = latest(spark, path)
    v = version(spark, path) + 1
    (part if done is None else done.unionByName(part)).write.mode("errorifexists").parquet(f"{path}/v={v}")
    return spark.read.schema(part.schema).parquet(f"{path}/v={v}")


def upsert_assets(spark: SparkSession, path: str, fetched: DataFrame, stamp: str) -> DataFrame:
    """(url, status, digest, tries, fetched_at): the ledger of assets at path after one more run of fetches (columns url, ok, digest).

    An asset that is stored stays as it is, its stamp too, unless its digest changed; a failed one counts its tries.
    """
    new = fetched.select("url", F.when(F.col("ok"), "stored").otherwise("failed").alias("status"), "digest", F.lit(1).alias("tries"), F.lit(stamp).alias("fetched_at")).dropDuplicates(["url"])
    old = latest(spark, path)
    if old is None:
        return upsert(spark, path, new, ["url"])
    o = old.select("url", F.col("status").alias("was"), F.col("digest").alias("held"), F.col("tries").alias("n"))
    j = new.join(o, "url", "left").filter("was is null or was = 'failed' or (status = 'stored' and not (digest <=> held))")
    return upsert(spark, path, j.select("url", "status", "digest", F.when(F.col("was") == "failed", F.col("n") + 1).otherwise(F.col("tries")).alias("tries"), "fetched_at"), ["url"])
