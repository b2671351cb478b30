"""Mixed timestamp formats and zones: a persisted dictionary of raw strings.

Raw strings are reduced to distinct (text, zone of the source) pairs before
anything else is done to them, each pair is parsed once, the parsed pairs are
kept as a Parquet table that later batches and later runs extend, and the
instants are joined back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.functions.instants import CANONICAL, known_zones, utc_micros
from chronolens.sources.staging import new_path, written

#: A session may name the folder of a dictionary that outlives it.
SETTING = "spark.chronolens.instants"
#: Stands for a missing zone; no zone has this name.
NO_ZONE = "?"


@dataclass
class InstantDictionary:
    """The persisted dictionary: columns raw, zone, utc_us; one row a pair. One writer at a time."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return self.spark.read.schema("raw string, zone string, utc_us long").parquet(self.path)

    def extend(self, keyed: DataFrame) -> DataFrame:
        """Parse the pairs of ``keyed`` that are not in the table yet and append them."""
        fresh = keyed.select("raw", "zone").distinct()
        if written(self.spark, self.path):
            fresh = fresh.join(self.read().select("raw", "zone"), ["raw", "zone"], "left_anti")
        parsed = fresh.withColumn("utc_us", utc_micros(F.col("raw"), F.col("zone"), known_zones(self.spark)))
        parsed.write.mode("append").parquet(self.path)
        return self.read()


def with_zone(df: DataFrame, devices: DataFrame, device_col: str, out: str = "__zone") -> DataFrame:
    """``df`` with the zone of its device; null where the device is null or unknown.

    Several rows for one device: the smallest zone name. The join's strategy is
    Spark's, by the measured size of ``devices``.
    """
    zones = devices.groupBy(F.col("device_name").alias("__device")).agg(F.min("time_zone").alias(out))
    return df.join(zones, df[device_col] == zones["__device"], "left").drop("__device")


def field_rows(df: DataFrame, devices: DataFrame, table_name: str, key: str, field: str) -> DataFrame:
    """One field of a table as (table_name, record_key, field_name, raw, zone) rows."""
    rows = df.select(F.col(key).alias("record_key"), F.col(field).alias("raw"), F.col("device_name").alias("__of")).where(F.col("raw").isNotNull())
    rows = with_zone(rows, devices, "__of")
    return rows.select(F.lit(table_name).alias("table_name"), "record_key", F.lit(field).alias("field_name"), "raw", F.coalesce("__zone", F.lit(NO_ZONE)).alias("zone"))


def normalise(batches: list[DataFrame], dictionary: InstantDictionary) -> DataFrame:
    """Rows of every batch with ``utc_us``.

    Each batch only adds what the dictionary lacks. Nulls, unreadable texts and
    wall-clock times without a device give null; an empty batch gives no rows;
    repeated rows stay repeated. Columns besides those of ``field_rows`` are
    passed through untouched.
    """
    for batch in batches:
        dictionary.extend(batch)
    rows = batches[0]
    for batch in batches[1:]:
        rows = rows.unionByName(batch)
    return rows.join(dictionary.read(), ["raw", "zone"], "left")


def rewritten(batches: list[DataFrame], dictionary: InstantDictionary) -> DataFrame:
    """Distinct (table_name, record_key, field_name, utc_us) of values that name a
    moment and are not written in the canonical form already."""
    due = [b.where(~F.col("raw").rlike(CANONICAL)) for b in batches]
    found = normalise(due, dictionary).where(F.col("utc_us").isNotNull())
    return found.select("table_name", "record_key", "field_name", "utc_us").distinct()


def new_dictionary(spark: SparkSession) -> InstantDictionary:
    """The dictionary in the folder that SETTING names, else a fresh one in the shared folder."""
    return InstantDictionary(spark, spark.conf.get(SETTING, None) or new_path(spark, "instants"))
