"""Streaming queries, drained over what a table holds, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.plans.analytics import DAY_US
from chronolens.plans.prelude import sql
from chronolens.sources import domain
from chronolens.sources.tables import table
from chronolens.streaming.clusters import cluster_stream, named_followers
from chronolens.streaming.sessions import KEYS, kind_of, offline_sessions, online_sessions
from chronolens.streaming.sources import UpdateLog, drain, latest_rows, ordered_stream, table_stream


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    """(device_name, app, us, what) of every assignment as stored, older versions too."""
    devices = domain.sub_frames(spark, sf).select("sub_frame_id", "device_name")
    plain = table(spark, sf, "activity_assignments").select("sub_frame_id", F.lower(F.trim("app_name")).alias("app"), F.unix_micros("timestamp").alias("us"), F.col("activity_cluster_id").alias("cluster_id"), F.lower(F.trim("activity_label")).alias("label"), F.lower("cluster_status").alias("status"))
    return plain.join(devices, "sub_frame_id", "left").select(*KEYS, "us", kind_of().alias("what"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Online sessions over the stream of assignments; a session's last update holds."""
    rows = ordered_stream(_assigned(spark, sf).where("us IS NOT NULL"), ["us", "what"], "online-sessions")
    updates = drain(online_sessions(rows), "online-sessions")
    last = updates.groupBy(*KEYS, "session").agg(F.max(F.struct("n", "end_us", "what", "start_us")).alias("l"))
    return last.select(*KEYS, "l.what", "l.start_us", "l.end_us", "l.n")


def sessions_batch(spark: SparkSession, sf: str) -> DataFrame:
    return offline_sessions(_assigned(spark, sf))


def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events an hour and type, from a stream with a watermark; the last update of a window holds."""
    stream = table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    counts = stream.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    flat = counts.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", "total")
    updates = UpdateLog(flat, "event-windows").drain(flat, "update")
    return latest_rows(updates, ["hour_us", "event_type"], ["batch"]).drop("batch")


def stream_latest_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments by key from micro-batches; the latest update of a key holds."""
    cols = ["sub_frame_id", "updated_us", "cluster_id", "status"]
    stream = table_stream(spark, sf, "activity_assignments").where("sub_frame_id IS NOT NULL").select("sub_frame_id", F.unix_micros("cluster_updated_at").alias("updated_us"), F.col("activity_cluster_id").alias("cluster_id"), F.lower("cluster_status").alias("status"))
    return latest_rows(drain(stream, "assignments"), cols[:1], cols[1:])


def online_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Online clusters of each device's app over all its days: captures in order, labels when they were
    assigned; a group's earlier members have its name too."""
    when = domain.sub_frames(spark, sf).where("us IS NOT NULL").select(F.col("sub_frame_id").alias("key"), "device_name", "us")
    captures = domain.vectors(spark, sf).join(when, "key").select(*KEYS, F.floor(F.col("us") / DAY_US).alias("day"), "us", F.lit(0).alias("kind"), "key", "vector", F.lit(None).cast("string").alias("label"))
    named = domain.assignments(spark, sf).where("label <> ''").select(F.col("sub_frame_id").alias("key"), F.col("us").alias("at"), "label")
    labels = captures.select(*KEYS, "day", "us", "key").join(named, "key").select(*KEYS, "day", F.greatest("us", "at").alias("us"), F.lit(1).alias("kind"), "key", F.array().cast("array<double>").alias("vector"), "label")
    events = ordered_stream(captures.unionByName(labels), ["us", "kind", "key"], "online-clusters")
    return named_followers(drain(cluster_stream(events, tuple(KEYS)), "online-clusters"), tuple(KEYS))


QUERIES = {f.__name__: f for f in (stream_sessions, sessions_batch, stream_event_windows, stream_latest_assignments, online_clusters)}

_RUNS = """a AS (SELECT s.device_name, lower(trim(app_name)) AS app, epoch_us(timestamp) AS us, coalesce(activity_cluster_id::VARCHAR, '-') || '|' || coalesce(lower(trim(activity_label)), '-') || '|' || coalesce(lower(cluster_status), '-') AS what FROM activity_assignments LEFT JOIN su s USING (sub_frame_id) WHERE app_name IS NOT NULL AND timestamp IS NOT NULL),
    m AS (SELECT *, CASE WHEN what IS DISTINCT FROM lag(what) OVER (PARTITION BY device_name, app ORDER BY us, what) THEN 1 ELSE 0 END AS fresh FROM a), k AS (SELECT *, sum(fresh) OVER (PARTITION BY device_name, app ORDER BY us, what ROWS UNBOUNDED PRECEDING) AS no FROM m) ;;
    SELECT device_name, app, min(what) AS what, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM k GROUP BY device_name, app, no"""
ORACLE = {
    "stream_sessions": sql("su", _RUNS),
    "sessions_batch": sql("su", _RUNS),
    "stream_event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_latest_assignments": "SELECT sub_frame_id, epoch_us(cluster_updated_at) AS updated_us, activity_cluster_id AS cluster_id, lower(cluster_status) AS status FROM activity_assignments WHERE sub_frame_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sub_frame_id ORDER BY cluster_updated_at DESC NULLS LAST, activity_cluster_id DESC NULLS LAST, lower(cluster_status) DESC NULLS LAST) = 1",
}
