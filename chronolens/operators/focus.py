"""How focused a day was: streaks, switches, fragmented hours, distractions, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolens.operators.islands import DAY_US, islands

HOUR_US = 3_600_000_000


def streaks(frames: DataFrame, interval_s: float) -> DataFrame:
    """(device_name, day, app, start_us, end_us, n, minutes): runs of one app within a UTC day.

    Frames without an app or a time are left out. A streak ends with its own last frame.
    """
    rows = frames.where("app IS NOT NULL AND app <> ''")
    runs = islands(rows, ["device_name"], "app", "frame_id", DAY_US, across=False)
    return runs.select("device_name", F.col("chunk").alias("day"), "app", "start_us", "end_us", "n", (F.col("n") * interval_s / 60).alias("minutes"))


def scores(streak: DataFrame, deep_minutes: float = 20.0) -> DataFrame:
    """Score and its parts for each (device_name, day).

    40 points for the share of deep work, 30 for few switches an hour (30 an hour
    and more give none), 30 for the longest streak up to an hour.
    """
    day = streak.groupBy("device_name", "day").agg(
        F.sum("minutes").alias("total"), F.coalesce(F.sum(F.when(F.col("minutes") >= deep_minutes, F.col("minutes"))), F.lit(0.0)).alias("deep"),
        F.max("minutes").alias("longest"), F.avg("minutes").alias("average"), (F.count(F.lit(1)) - 1).alias("switches"),
    )
    an_hour = F.col("switches") / (F.col("total") / 60)
    raw = 40 * F.least(F.col("deep") / F.col("total"), F.lit(1.0)) + 30 * F.greatest(F.lit(0.0), 1 - an_hour / 30) + 30 * F.least(F.col("longest") / 60, F.lit(1.0))
    return day.select(
        "device_name", "day", F.bround(F.round(raw, 6), 0).cast("long").alias("score"), F.round("total", 3).alias("total_minutes"), F.round("deep", 3).alias("deep_minutes"),
        F.round("longest", 3).alias("longest_minutes"), F.round("average", 3).alias("average_minutes"), "switches", F.round(an_hour, 3).alias("switches_an_hour"),
    )


def fragmented_hours(streak: DataFrame, least: int) -> DataFrame:
    """(device_name, hour_us, switches): hours with at least ``least`` switches to a new streak."""
    order = Window.partitionBy("device_name", "day").orderBy("start_us")
    changed = streak.withColumn("k", F.row_number().over(order)).where("k > 1")
    hours = changed.groupBy("device_name", (F.floor(F.col("start_us") / HOUR_US) * HOUR_US).alias("hour_us")).agg(F.count(F.lit(1)).alias("switches"))
    return hours.where(F.col("switches") >= least)


def distractions(streak: DataFrame, below_minutes: float, k: int = 5) -> DataFrame:
    """(device_name, day, app, short_streaks): the ``k`` apps with most short streaks; ties by first appearance."""
    short = streak.where(F.col("minutes") < below_minutes).groupBy("device_name", "day", "app").agg(F.count(F.lit(1)).alias("short_streaks"), F.min("start_us").alias("__first"))
    order = Window.partitionBy("device_name", "day").orderBy(F.desc("short_streaks"), "__first", "app")
    return short.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("device_name", "day", "app", "short_streaks", "place")
