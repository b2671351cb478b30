"""Queries on the state of the data itself: instants, sessions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.functions.instants import known_zones, utc_micros
from chronolens.operators.references import orphans, tidy_key
from chronolens.operators.sessions import latest_labels, one_per_record, sessionize
from chronolens.operators.timestamps import field_rows, new_dictionary, rewritten, with_zone
from chronolens.sources.tables import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    frames, subs, devices = table(spark, sf, "frames"), table(spark, sf, "sub_frames"), table(spark, sf, "devices")
    batches = [
        field_rows(frames, devices, "frames", "frame_id", "timestamp"),
        field_rows(frames, devices, "frames", "frame_id", "created_at"),
        field_rows(subs, devices, "sub_frames", "sub_frame_id", "timestamp"),
    ]
    return rewritten(batches, new_dictionary(spark))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    subs = with_zone(table(spark, sf, "sub_frames"), table(spark, sf, "devices"), "device_name")
    events = subs.select("sub_frame_id", "device_name", F.lower(F.trim("app_name")).alias("app_key"), utc_micros(F.col("timestamp"), F.col("__zone"), known_zones(spark)).alias("us"))
    events = events.where((F.col("app_key") != "") & F.col("us").isNotNull())
    labelled = one_per_record(events, "sub_frame_id").join(latest_labels(table(spark, sf, "activity_assignments")), "sub_frame_id", "left")
    return sessionize(labelled, ["device_name", "app_key"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("device_name", "app_key", "start_us", "end_us", "n_events", "n_labels")


def p2_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("device_name", "app_key", "start_us", "end_us", F.round("duration_s", 3).alias("duration_s"), "n_events", "n_labels")


def _micros(name: str = "created_at") -> F.Column:
    return F.unix_micros(F.col(name).cast("timestamp")).alias("created_us")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda name: table(spark, sf, name)
    gone = get("deleted_rows").select("table_name", tidy_key(F.col("record_key")).alias("ref_key"))
    frames = with_zone(get("frames"), get("devices"), "device_name")
    frame_us = utc_micros(F.col("created_at"), F.col("__zone"), known_zones(spark)).alias("created_us")
    fields = [
        ("frame_subframe_mapping", "sub_frame_id", get("frame_subframe_mapping").select(F.col("id").cast("string").alias("record_key"), tidy_key(F.col("sub_frame_id")).alias("ref_key"), _micros()), "sub_frames", "sub_frame_id"),
        ("sub_frames", "window_chunk_id", get("sub_frames").select(F.col("sub_frame_id").alias("record_key"), tidy_key(F.col("window_chunk_id")).alias("ref_key"), _micros()), "window_chunks", "id"),
        ("frames", "video_chunk_id", frames.select(F.col("frame_id").alias("record_key"), tidy_key(F.col("video_chunk_id")).alias("ref_key"), frame_us), "video_chunks", "id"),
    ]
    out = None
    for table_name, field, refs, parent, key in fields:
        stored = get(parent).select(tidy_key(F.col(key)).alias("ref_key"), _micros())
        found = orphans(refs, stored, gone.where(F.col("table_name") == parent).select("ref_key"))
        found = found.select(F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), "record_key", "missing_key", "reason", "period").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p3_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).groupBy("table_name", "field_name", "reason", "period").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("missing_key").alias("n_keys"))


# One raw column and the device's zone to microseconds, for DuckDB.
_INSTANT = r"""
    SELECT x.*, CASE
        WHEN regexp_full_match(u, '\d{{9,11}}') THEN u::BIGINT * 1000000
        WHEN regexp_full_match(u, '\d{{12,14}}') THEN u::BIGINT * 1000
        WHEN regexp_full_match(u, '\d{{15,17}}') THEN u::BIGINT
        WHEN off <> '' THEN epoch_us(wall) + us6 - CASE WHEN off[1] IN ('+', '-') THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (off[2:3]::BIGINT * 60 + right(off, 2)::BIGINT) * 60000000 ELSE 0 END
        WHEN regexp_matches(u, '^\d{{8}}_') OR regexp_matches(u, '^\d{{4}}-\d{{2}}-\d{{2}}\s') THEN epoch_us(wall) + us6
        WHEN timezone(zone, timezone(zone, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(zone, wall) - INTERVAL 1 HOUR) + us6
        ELSE epoch_us(timezone(zone, wall)) + us6 END AS utc_us
    FROM (
        SELECT y.*, rpad(left(frac, 6), 6, '0')::BIGINT AS us6, coalesce(
            try_strptime(bare, '%Y-%m-%dT%H:%M:%S'), try_strptime(bare, '%Y-%m-%d %H:%M:%S'), try_strptime(bare, '%d.%m.%Y %H:%M:%S'),
            try_strptime(bare, '%m/%d/%Y %I:%M:%S %p'), try_strptime(bare, '%a, %d %b %Y %H:%M:%S'), try_strptime(bare, '%Y%m%d_%H%M%S')) AS wall
        FROM (
            SELECT z.*, regexp_extract(u, '(\d{{2}}:\d{{2}}:\d{{2}})[.](\d+)|_\d{{6}}_(\d+)$', 2) || regexp_extract(u, '_\d{{6}}_(\d+)$', 1) AS frac,
                regexp_extract(regexp_replace(u, '\[.*\]$', ''), ':\d{{2}}(?:[.]\d+)?\s*(Z|UTC|GMT|[+-]\d{{2}}:?\d{{2}})$', 1) AS off,
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '\[.*\]$', ''), '(:\d{{2}}(?:[.]\d+)?)\s*(Z|UTC|GMT|[+-]\d{{2}}:?\d{{2}})$', '\1'), '(:\d{{2}})[.]\d+$', '\1'), '^(\d{{8}}_\d{{6}})_\d+$', '\1') AS bare
            FROM (SELECT s.*, upper(trim(s.raw)) AS u, d.time_zone AS zone FROM ({rows}) s LEFT JOIN devices d ON d.device_name = s.dev) z
        ) y
    ) x"""

P5_SQL = f"""
WITH rows AS (
    SELECT 'frames' AS table_name, frame_id AS record_key, 'timestamp' AS field_name, timestamp AS raw, device_name AS dev FROM frames
    UNION ALL SELECT 'frames', frame_id, 'created_at', created_at, device_name FROM frames
    UNION ALL SELECT 'sub_frames', sub_frame_id, 'timestamp', timestamp, device_name FROM sub_frames),
done AS ({_INSTANT.format(rows="SELECT * FROM rows")})
SELECT DISTINCT table_name, record_key, field_name, utc_us FROM done
WHERE utc_us IS NOT NULL AND NOT regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{6}}\\+00:00')
"""

_P2 = f"""
WITH done AS ({_INSTANT.format(rows="SELECT sub_frame_id, device_name, lower(trim(app_name)) AS app_key, timestamp AS raw, device_name AS dev FROM sub_frames WHERE trim(app_name) <> ''")}),
ev AS (SELECT sub_frame_id, device_name, app_key, utc_us AS us FROM done WHERE utc_us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sub_frame_id ORDER BY device_name NULLS FIRST, app_key, utc_us) = 1),
lab AS (SELECT sub_frame_id, lower(trim(activity_label)) AS label FROM activity_assignments
        QUALIFY row_number() OVER (PARTITION BY sub_frame_id ORDER BY cluster_updated_at DESC NULLS LAST, lower(trim(activity_label)) DESC NULLS LAST) = 1),
marked AS (SELECT ev.*, label, CASE WHEN us - lag(us) OVER (PARTITION BY device_name, app_key ORDER BY us) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM ev LEFT JOIN lab USING (sub_frame_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY device_name, app_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM marked)
SELECT device_name, app_key, min(us) AS start_us, max(us) AS end_us, /*extra*/count(*) AS n_events, count(DISTINCT label) AS n_labels FROM numbered GROUP BY device_name, app_key, no
"""
P2_SQL, P2_SESSIONS_SQL = _P2, _P2.replace("/*extra*/", "round((max(us) - min(us)) / 1e6, 3) AS duration_s, ")

_P3 = f"""
fr AS ({_INSTANT.format(rows="SELECT frame_id, video_chunk_id, created_at AS raw, device_name AS dev FROM frames")}),
refs AS (
    SELECT 'frame_subframe_mapping' AS table_name, 'sub_frame_id' AS field_name, id::VARCHAR AS record_key, lower(trim(sub_frame_id)) AS k, epoch_us(created_at) AS us, 'sub_frames' AS parent FROM frame_subframe_mapping
    UNION ALL SELECT 'sub_frames', 'window_chunk_id', sub_frame_id, window_chunk_id::VARCHAR, epoch_us(created_at), 'window_chunks' FROM sub_frames
    UNION ALL SELECT 'frames', 'video_chunk_id', frame_id, video_chunk_id::VARCHAR, utc_us, 'video_chunks' FROM fr),
parents AS (
    SELECT parent, k, min(us) AS us FROM (
        SELECT 'sub_frames' AS parent, lower(trim(sub_frame_id)) AS k, epoch_us(created_at) AS us FROM sub_frames
        UNION ALL SELECT 'window_chunks', id::VARCHAR, epoch_us(created_at) FROM window_chunks
        UNION ALL SELECT 'video_chunks', id::VARCHAR, epoch_us(created_at) FROM video_chunks) GROUP BY 1, 2),
gone AS (SELECT DISTINCT table_name AS parent, lower(trim(record_key)) AS k FROM deleted_rows),
found AS (
    SELECT DISTINCT r.table_name, r.field_name, r.record_key, r.k AS missing_key,
        CASE WHEN p.k IS NOT NULL THEN CASE WHEN p.us > r.us THEN 'late' END WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'absent' END AS reason,
        coalesce(strftime(make_timestamp(r.us), '%Y-%m'), 'unknown') AS period
    FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.k = r.k LEFT JOIN gone g ON g.parent = r.parent AND g.k = r.k
    WHERE r.k IS NOT NULL AND r.k <> '')
"""
P3_SQL = f"WITH {_P3} SELECT * FROM found WHERE reason IS NOT NULL"
P3_PERIOD_SQL = f"WITH {_P3} SELECT table_name, field_name, reason, period, count(*) AS n_references, count(DISTINCT missing_key) AS n_keys FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4"

QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p3_found": p3_found, "p3_by_period": p3_by_period, "p5_found": p5_found}
ORACLE = {"p2_found": P2_SQL, "p2_sessions": P2_SESSIONS_SQL, "p3_found": P3_SQL, "p3_by_period": P3_PERIOD_SQL, "p5_found": P5_SQL}
