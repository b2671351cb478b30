"""Inactivity sessions by time chunks.

Each key's events are cut into fixed time chunks, sessions are built inside
every (key, chunk), and only partial sessions that lie within the gap of a
chunk edge are merged with their neighbours. A task therefore holds one chunk
of one key, or a key's edge pieces (two a chunk at most), never a key's whole
history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_US = 1_800_000_000
CHUNK_US = 6 * 3_600_000_000


def latest_labels(assignments: DataFrame) -> DataFrame:
    """One label for each sub_frame_id: of the row with the latest cluster_updated_at.

    Rows without an update time count as the oldest; equal times are decided by
    the larger label. Labels are trimmed and lower-cased; null stays null.
    """
    label = F.lower(F.trim("activity_label"))
    return (
        assignments.where(F.col("sub_frame_id").isNotNull())
        .groupBy("sub_frame_id")
        .agg(F.max(F.struct(F.col("cluster_updated_at"), label.alias("label"))).alias("__last"))
        .select("sub_frame_id", F.col("__last.label").alias("label"))
    )


def one_per_record(events: DataFrame, record_key: str) -> DataFrame:
    """Repeated rows of one record become one (null keys: one per distinct row)."""
    rest = [c for c in events.columns if c != record_key]
    spare = F.when(F.col(record_key).isNull(), F.struct(*rest))
    return (
        events.groupBy(record_key, spare.alias("__spare"))
        .agg(F.min(F.struct(*rest)).alias("__row"))
        .select(record_key, "__row.*")
    )


def sessionize(events: DataFrame, keys: list[str], gap_us: int = GAP_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Sessions of ``events`` (keys, us, label): start_us, end_us, duration_s, n_events, n_labels.

    A gap of exactly ``gap_us`` still belongs to the session. Null keys are a
    key of their own; events without ``us`` are left out; ties in time and
    repeated rows count as events; an empty input gives no rows.
    """
    if chunk_us <= 2 * gap_us:
        raise ValueError("a chunk must be longer than two gaps")
    clean = events.where(F.col("us").isNotNull()).select(*keys, "us", "label", F.floor(F.col("us") / F.lit(chunk_us)).alias("__chunk"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy("us")
    fresh = F.coalesce((F.col("us") - F.lag("us").over(inside) > gap_us).cast("int"), F.lit(0))
    partial = (
        clean.withColumn("__fresh", fresh)
        .withColumn("__no", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__chunk", "__no")
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_events"), F.collect_set("label").alias("__labels"))
    )
    edge_left = F.col("start_us") - F.col("__chunk") * chunk_us <= gap_us
    edge_right = (F.col("__chunk") + 1) * chunk_us - F.col("end_us") <= gap_us
    partial = partial.withColumn("__edge", edge_left | edge_right)

    along = Window.partitionBy(*keys, "__edge").orderBy("start_us")
    parted = F.coalesce((F.col("start_us") - F.lag("end_us").over(along) > gap_us).cast("int"), F.lit(0))
    merged = (
        partial.where("__edge")
        .withColumn("__parted", parted)
        .withColumn("__no", F.sum("__parted").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__no")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"), F.array_distinct(F.flatten(F.collect_list("__labels"))).alias("__labels"))
    )
    shape = lambda df: df.select(*keys, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), "n_events", F.size("__labels").cast("long").alias("n_labels"))
    return shape(partial.where(~F.col("__edge"))).unionByName(shape(merged))
