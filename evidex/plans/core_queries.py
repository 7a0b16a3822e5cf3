"""Queries of the core: the general data-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.timestamps import normalise_timestamps
from evidex.session import fixed_rows, table


def timestamp_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every dated text of incidents and source records with its normal form (null where it gives no date)."""
    zones = table(spark, d, "region_zones").select("region", "iana_zone")
    inc = table(spark, d, "incidents").select(F.lit("incidents").alias("table_name"), F.col("case_id").alias("row_key"), F.col("occurred_at_text").alias("raw"), "region")
    inc = inc.join(zones, "region", "left").select("table_name", "row_key", "raw", "iana_zone")
    rec = table(spark, d, "source_records").select(F.lit("source_records").alias("table_name"), F.col("identity_key").alias("row_key"), F.col("incident_date_hint").alias("raw"), F.lit(None).cast("string").alias("iana_zone"))
    both = inc.unionByName(rec).filter("row_key is not null and raw is not null")
    fixed = [r[0] for r in fixed_rows(zones.select("iana_zone").distinct(), 1000)]
    return normalise_timestamps(both, "raw", "iana_zone", zones=[z for z in fixed if z])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of the date of every incident and source record; copies of a row give one row."""
    return timestamp_forms(spark, d).filter("normal_form is not null").select("table_name", "row_key", "normal_form").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each table came out at which precision, or not at all."""
    width = F.length("normal_form")
    kind = F.when(width == 17, "minute").when(width == 10, "day").when(width == 7, "month").when(width == 4, "year").when(width == 5, "decade").otherwise("none")
    return timestamp_forms(spark, d).groupBy("table_name", kind.alias("precision")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
ORACLE: dict[str, str] = {}
