"""The activity memory's tables as clean views: one row a record, real instants.

Repeated rows with one key count once, keys are trimmed and lower-cased where
they refer to another table, and text times become UTC microseconds. Frames and
sub_frames, whose text times have to be parsed and whose rows have to be shuffled
to find repeated ones, are kept in the shared folder in the order of time once a
session has made them, so a time range reads only the row groups it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.functions.instants import known_zones, utc_micros
from chronolens.operators.timestamps import with_zone
from chronolens.sources.staging import new_path, written
from chronolens.sources.tables import table


def _least(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One stored row a key: the least by all its columns in order, nulls first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("__row")).select(key, "__row.*")


#: Bytes of stored tables that make one file of a kept view.
BYTES_A_FILE = 16 << 20
_kept: dict[tuple, str] = {}


def _state(spark: SparkSession, sf: str, name: str) -> tuple:
    """What tells whether a stored table is still the same: its bytes, files and time of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(path)
    return summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()


def _in_time_order(spark: SparkSession, sf: str, name: str, view: DataFrame) -> DataFrame:
    """``view`` of table ``name``, written in the order of ``us`` when first asked for; made
    again for tables that have changed since."""
    own = _state(spark, sf, name)
    key = (spark.sparkContext.applicationId, sf, name, own, _state(spark, sf, "devices"))
    if key not in _kept or not written(spark, _kept[key]):
        path = new_path(spark, f"{name}-view")
        view.repartitionByRange(max(1, -(-own[0] // BYTES_A_FILE)), "us").sortWithinPartitions("us").write.parquet(path)
        _kept[key] = path
    return spark.read.schema(view.schema).parquet(_kept[key])


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """frame_id, us, device_name, monitor_id, image_path, video_chunk_id, offset_index, app and window in
    focus, own_app (null or empty for a picture of the full screen)."""
    rows = with_zone(table(spark, sf, "frames"), table(spark, sf, "devices"), "device_name")
    rows = rows.select("frame_id", utc_micros(F.col("timestamp"), F.col("__zone"), known_zones(spark)).alias("us"), "device_name", "monitor_id", "image_path", "video_chunk_id", "offset_index", F.trim("focused_app_name").alias("app"), F.col("focused_window_name").alias("window"), F.trim("app_name").alias("own_app"))
    return _in_time_order(spark, sf, "frames", _least(rows, "frame_id", rows.columns[1:]))


def sub_frames(spark: SparkSession, sf: str) -> DataFrame:
    """sub_frame_id, us, device_name, app (trimmed, lower case), window_name, window_chunk_id, offset_index."""
    rows = with_zone(table(spark, sf, "sub_frames"), table(spark, sf, "devices"), "device_name")
    rows = rows.select("sub_frame_id", utc_micros(F.col("timestamp"), F.col("__zone"), known_zones(spark)).alias("us"), "device_name", F.lower(F.trim("app_name")).alias("app"), "window_name", "window_chunk_id", "offset_index")
    return _in_time_order(spark, sf, "sub_frames", _least(rows, "sub_frame_id", rows.columns[1:]))


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """frame_id, sub_frame_id: each pair once."""
    tidy = lambda c: F.lower(F.trim(c)).alias(c)
    return table(spark, sf, "frame_subframe_mapping").select(tidy("frame_id"), tidy("sub_frame_id")).where("frame_id <> '' AND sub_frame_id <> ''").distinct()


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """id, frame_id, sub_frame_id, text, confidence, n (length), engine, created_us."""
    rows = table(spark, sf, "ocr_text").select("id", "frame_id", "sub_frame_id", "text", "confidence", F.length("text").cast("long").alias("n"), F.lower("ocr_engine").alias("engine"), F.unix_micros("created_at").alias("created_us"))
    return _least(rows, "id", rows.columns[1:])


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """sub_frame_id with its latest app, us (when assigned), cluster_id, label, status, group_id."""
    rows = table(spark, sf, "activity_assignments").where("sub_frame_id IS NOT NULL")
    last = F.struct(
        F.unix_micros("cluster_updated_at").alias("updated_us"), F.lower(F.trim("activity_label")).alias("label"), F.col("activity_cluster_id").alias("cluster_id"), F.lower("cluster_status").alias("status"),
        F.unix_micros("timestamp").alias("us"), F.lower(F.trim("app_name")).alias("app"), F.col("pending_group_id").alias("group_id"), F.lower(F.trim("provisional_label")).alias("provisional"),
    )
    return rows.groupBy("sub_frame_id").agg(F.max(last).alias("l")).select("sub_frame_id", "l.*")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """id, app, label, status, frame_count, centroid, representative_frame_ids."""
    return table(spark, sf, "activity_clusters").select("id", F.lower(F.trim("app_name")).alias("app"), F.lower(F.trim("label")).alias("label"), F.lower("cluster_status").alias("status"), "frame_count", "centroid", "representative_frame_ids")


def vectors(spark: SparkSession, sf: str, dim: int = 64) -> DataFrame:
    """key, vector (unit length, double), app: usable vectors, one row for each key and vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = (F.size("embedding") == dim) & finite & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, sf, "sub_frame_data").where(F.col("frame_id").isNotNull() & usable).select(F.col("frame_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lower(F.trim("app_name")).alias("app"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return _least(rows, "key", ["v", "app"]).select("key", F.transform("v", lambda x: x / norm).alias("vector"), "app")
