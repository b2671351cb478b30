"""Orphan references against compressed runs of parent keys.

Any text key splits into a stem (everything before its last digits), the
number of those digits and their value, so sorted parent keys of one stem
compress into contiguous runs. Distinct reference keys are matched as-of to
the start of the preceding run; a key beyond that run's end has no parent. The
match runs inside (stem, width, block of numbers), so no task holds more than
one block of keys, and rows that share a key are counted once before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def tidy_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))


def _coded(df: DataFrame) -> DataFrame:
    """``df`` (ref_key, ...) with stem, width and number; keys without digits get number 0."""
    digits = F.regexp_extract("ref_key", r"([0-9]{1,18})$", 1)
    return df.select(
        "*",
        F.expr("left(ref_key, length(ref_key) - length(regexp_extract(ref_key, '([0-9]{1,18})$', 1)))").alias("stem"),
        F.length(digits).alias("width"),
        F.coalesce(digits.try_cast("long"), F.lit(0)).alias("number"),
    ).withColumn("block", F.floor(F.col("number") / BLOCK))


_PLACE = ["stem", "width", "block"]


def parent_runs(parents: DataFrame) -> DataFrame:
    """Runs of consecutive keys: first_number, last_number, newest (the largest known
    created_us in the run; a parent without one is never later than a record)."""
    keys = _coded(parents.groupBy("ref_key").agg(F.min("created_us").alias("created_us")))
    order = Window.partitionBy(*_PLACE).orderBy("number")
    return (
        keys.withColumn("run", F.col("number") - F.row_number().over(order))
        .groupBy(*_PLACE, "run")
        .agg(F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.max("created_us").alias("newest"))
        .drop("run")
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct ``keys`` (ref_key, oldest_ref_us) as-of joined to the runs: present, newest."""
    probe = _coded(keys).select("ref_key", "oldest_ref_us", *_PLACE, "number", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("last_number"), F.lit(None).cast("long").alias("newest"))
    start = runs.select(F.lit(None).cast("string").alias("ref_key"), F.lit(None).cast("long").alias("oldest_ref_us"), *_PLACE, F.col("first_number").alias("number"), F.lit(0).alias("kind"), "last_number", "newest")
    order = Window.partitionBy(*_PLACE).orderBy("number", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.col("kind") == 0, F.struct("last_number", "newest")), ignorenulls=True).over(order)
    return (
        start.unionByName(probe)
        .withColumn("run", run)
        .where("kind = 1")
        .select("ref_key", "oldest_ref_us", F.coalesce(F.col("number") <= F.col("run.last_number"), F.lit(False)).alias("present"), F.col("run.newest").alias("newest"))
    )


def orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """References without a usable parent: record_key, missing_key, reason, period.

    ``refs`` has (record_key, ref_key, created_us), ``parents`` and ``deleted``
    have (ref_key[, created_us]); all keys are tidied. Null and empty keys are
    no references; a null record_key is kept as null. reason is ``deleted``,
    ``absent`` or ``late`` (parent stored after the record, both times known).
    Repeated parents count with their earliest time. Empty tables give no rows
    (refs) or make every reference an orphan (parents).
    """
    real = refs.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))
    stored = parents.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))
    keys = real.groupBy("ref_key").agg(F.min("created_us").alias("oldest_ref_us"))
    matched = match_runs(keys, parent_runs(stored))
    # what is present and older than every reference to it needs no further look
    open_keys = matched.where(~F.col("present") | (F.col("newest") > F.col("oldest_ref_us"))).select("ref_key", "present")
    listed = deleted.where(F.col("ref_key").isNotNull()).select("ref_key").distinct().withColumn("listed", F.lit(True))
    since = stored.groupBy("ref_key").agg(F.min("created_us").alias("parent_us"))
    status = (
        open_keys.join(listed, "ref_key", "left")
        .join(since, "ref_key", "left")
        .select("ref_key", "present", F.coalesce("listed", F.lit(False)).alias("listed"), "parent_us")
    )
    reason = F.when(F.col("present"), F.when(F.col("parent_us") > F.col("created_us"), F.lit("late"))).when(F.col("listed"), F.lit("deleted")).otherwise(F.lit("absent"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_us") / F.lit(86_400_000_000)).cast("int"))
    month = F.date_format(day, "yyyy-MM")  # by UTC days, whatever the session's zone
    return (
        real.join(status, "ref_key")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("record_key", F.col("ref_key").alias("missing_key"), "reason", F.coalesce(month, F.lit("unknown")).alias("period"))
    )
