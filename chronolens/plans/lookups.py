"""Point lookups, joins and maintenance over the activity memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolens.functions.text import readable_size, safe_name
from chronolens.plans.analytics import DAY_US, END_US, START_US
from chronolens.plans.prelude import sql
from chronolens.sources import domain
from chronolens.sources.tables import table

KEYWORD, LEAST_CONFIDENCE, PAGE, OFFSET = "harbour", 0.6, 50, 100
MOMENTS_S = 3_600  # one snapshot an hour

QUERIES: dict = {}
ORACLE: dict = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _frame_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = domain.texts(spark, sf).where("frame_id IS NOT NULL").select("frame_id", F.col("id").alias("text_id"), "confidence", "n")
    return domain.frames(spark, sf).select("frame_id", "us", "app").join(texts, "frame_id", "left")


_FT = "SELECT f.frame_id, f.us, f.app, t.id AS text_id, t.confidence, t.n FROM fr f LEFT JOIN tx t ON t.frame_id = f.frame_id"


@_query(sql("fr tx", f"{_FT} WHERE f.us IS NOT NULL ORDER BY us DESC, f.frame_id, text_id LIMIT {PAGE}"))
def recent_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Newest frames with each of their texts (a frame with several fans out)."""
    return _frame_texts(spark, sf).where("us IS NOT NULL").orderBy(F.desc("us"), "frame_id", "text_id").limit(PAGE)


@_query(sql("fr tx", f"{_FT} WHERE f.us IS NOT NULL ORDER BY us, f.frame_id, text_id LIMIT {PAGE} OFFSET {OFFSET}"))
def frames_page(spark: SparkSession, sf: str) -> DataFrame:
    return _frame_texts(spark, sf).where("us IS NOT NULL").orderBy("us", "frame_id", "text_id").offset(OFFSET).limit(PAGE)


@_query(sql("fr tx", f"{_FT} WHERE f.us >= {START_US} AND f.us < {END_US}"))
def frames_in_range(spark: SparkSession, sf: str) -> DataFrame:
    return _frame_texts(spark, sf).where(f"us >= {START_US} AND us < {END_US}")


def _window_texts(spark: SparkSession, sf: str) -> DataFrame:
    subs = domain.sub_frames(spark, sf).select("sub_frame_id", "us", "app", "window_name")
    labels = domain.assignments(spark, sf).select("sub_frame_id", "label")
    texts = domain.texts(spark, sf).where("sub_frame_id IS NOT NULL").select("id", "sub_frame_id", "text", "confidence", "n")
    return texts.join(subs, "sub_frame_id").join(labels, "sub_frame_id", "left")


_WT = "SELECT t.id, sub_frame_id, s.us, s.app, a.label, t.confidence, t.n FROM tx t JOIN su s USING (sub_frame_id) LEFT JOIN asg a USING (sub_frame_id)"


@_query(sql("tx su asg", f"{_WT} WHERE s.us BETWEEN {START_US} AND {END_US} AND t.confidence >= {LEAST_CONFIDENCE}"))
def ocr_texts_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _window_texts(spark, sf).where(f"us BETWEEN {START_US} AND {END_US} AND confidence >= {LEAST_CONFIDENCE}").drop("text", "window_name").select("id", "sub_frame_id", "us", "app", "label", "confidence", "n")


@_query(sql("tx su asg", f"{_WT} WHERE t.text ILIKE '%{KEYWORD}%' AND t.confidence >= {LEAST_CONFIDENCE}"))
def ocr_texts_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return _window_texts(spark, sf).where(F.col("text").ilike(f"%{KEYWORD}%") & (F.col("confidence") >= LEAST_CONFIDENCE)).select("id", "sub_frame_id", "us", "app", "label", "confidence", "n")


@_query(sql("tx su", "SELECT sub_frame_id, s.app, s.us, t.id FROM su s LEFT JOIN tx t USING (sub_frame_id) WHERE s.app ILIKE '%notes%'"))
def ocr_by_app(spark: SparkSession, sf: str) -> DataFrame:
    texts = domain.texts(spark, sf).select("sub_frame_id", "id")
    return domain.sub_frames(spark, sf).where(F.col("app").ilike("%notes%")).select("sub_frame_id", "app", "us").join(texts, "sub_frame_id", "left")


@_query(sql("fr su ma", "SELECT m.frame_id, row_number() OVER (PARTITION BY m.frame_id ORDER BY s.app NULLS FIRST, s.window_name NULLS FIRST, sub_frame_id) AS place, sub_frame_id, s.app, s.window_name FROM ma m JOIN su s USING (sub_frame_id) JOIN fr f ON f.frame_id = m.frame_id"))
def frame_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame's windows in reading order."""
    rows = domain.mapping(spark, sf).join(domain.sub_frames(spark, sf).select("sub_frame_id", "app", "window_name"), "sub_frame_id").join(domain.frames(spark, sf).select("frame_id"), "frame_id")
    order = Window.partitionBy("frame_id").orderBy("app", "window_name", "sub_frame_id")
    return rows.select("frame_id", F.row_number().over(order).cast("long").alias("place"), "sub_frame_id", "app", "window_name")


@_query(sql("fr", "SELECT f.frame_id, c.id AS chunk_id, c.file_path, f.offset_index, round(f.offset_index / nullif(c.fps, 0), 3) AS second FROM fr f JOIN video_chunks c ON c.id = f.video_chunk_id"))
def frame_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "video_chunks").select(F.col("id").alias("chunk_id"), "file_path", "fps")
    rows = domain.frames(spark, sf).join(chunks, F.col("video_chunk_id") == F.col("chunk_id"))
    return rows.select("frame_id", "chunk_id", "file_path", "offset_index", F.round(F.col("offset_index") / F.when(F.col("fps") != 0, F.col("fps")), 3).alias("second"))


@_query(sql("su fr", r"""p AS (SELECT s.sub_frame_id, w.file_path AS own, s.offset_index, f.image_path, try_cast(split_part(f.image_path, ':', 2) AS BIGINT) AS cid, try_cast(split_part(f.image_path, ':', 3) AS INTEGER) AS off
    FROM su s LEFT JOIN window_chunks w ON s.window_chunk_id > 0 AND w.id = s.window_chunk_id LEFT JOIN fr f ON f.frame_id = s.sub_frame_id) ;; SELECT sub_frame_id, coalesce(own, v.file_path) AS file_path, CASE WHEN own IS NOT NULL THEN offset_index WHEN v.id IS NOT NULL THEN off END AS offset_index
    FROM p LEFT JOIN video_chunks v ON p.own IS NULL AND p.image_path LIKE 'video_chunk:%' AND v.id = p.cid AND p.cid > 0"""))
def sub_frame_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where each window's picture lies: its window chunk, else the chunk its frames row names."""
    own = table(spark, sf, "window_chunks").where("id > 0").select(F.col("id").alias("window_chunk_id"), F.col("file_path").alias("own"))
    parts = F.split("image_path", ":")
    mirror = domain.frames(spark, sf).where("image_path LIKE 'video_chunk:%'").select(F.col("frame_id").alias("sub_frame_id"), F.get(parts, F.lit(1)).try_cast("long").alias("cid"), F.get(parts, F.lit(2)).try_cast("int").alias("off"))
    video = table(spark, sf, "video_chunks").where("id > 0").select(F.col("id").alias("cid"), F.col("file_path").alias("other"))
    rows = domain.sub_frames(spark, sf).select("sub_frame_id", "window_chunk_id", "offset_index").join(own, "window_chunk_id", "left").join(mirror, "sub_frame_id", "left").join(video, "cid", "left")
    return rows.select("sub_frame_id", F.coalesce("own", "other").alias("file_path"), F.when(F.col("own").isNotNull(), F.col("offset_index")).when(F.col("other").isNotNull(), F.col("off")).alias("offset_index"))


@_query(sql("fr su ma", "SELECT frame_id, f.us, count(s.sub_frame_id) AS windows, coalesce(string_agg(s.sub_frame_id || '@' || coalesce(w.file_path, '-'), ',' ORDER BY s.sub_frame_id), '') AS parts FROM fr f LEFT JOIN ma m USING (frame_id) LEFT JOIN su s ON s.sub_frame_id = m.sub_frame_id LEFT JOIN window_chunks w ON w.id = s.window_chunk_id GROUP BY 1, 2"))
def frames_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame with the list of its windows and their chunks, flattened to one text."""
    chunks = table(spark, sf, "window_chunks").select(F.col("id").alias("window_chunk_id"), "file_path")
    subs = domain.sub_frames(spark, sf).select("sub_frame_id", "window_chunk_id").join(chunks, "window_chunk_id", "left")
    parts = domain.mapping(spark, sf).join(subs, "sub_frame_id").groupBy("frame_id").agg(F.array_sort(F.collect_list(F.concat("sub_frame_id", F.lit("@"), F.coalesce("file_path", F.lit("-"))))).alias("p"))
    rows = domain.frames(spark, sf).select("frame_id", "us").join(parts, "frame_id", "left")
    return rows.select("frame_id", "us", F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("windows"), F.coalesce(F.array_join("p", ","), F.lit("")).alias("parts"))


_MOMENTS = f"h AS (SELECT DISTINCT device_name, (us // {MOMENTS_S}000000) * {MOMENTS_S}000000 AS moment FROM fr WHERE us IS NOT NULL)"


@_query(sql("fr", f"""{_MOMENTS}, c AS (SELECT h.device_name, h.moment, f.frame_id, abs(f.us - h.moment) AS away FROM h JOIN fr f ON f.device_name IS NOT DISTINCT FROM h.device_name AND f.us BETWEEN h.moment - {MOMENTS_S}000000 AND h.moment + {MOMENTS_S}000000) ;;
    SELECT device_name, moment, frame_id, away FROM c QUALIFY row_number() OVER (PARTITION BY device_name, moment ORDER BY away, frame_id) = 1"""))
def nearest_frames(spark: SparkSession, sf: str) -> DataFrame:
    """For each hour with frames, the frame nearest to its start, before or after (as-of join).

    Frames are copied to the hour they lie in and the next, so the match is an
    equality on the hour; no frame meets every moment.
    """
    width = MOMENTS_S * 1_000_000
    rows = domain.frames(spark, sf).where("us IS NOT NULL").select("device_name", "us", "frame_id", F.floor(F.col("us") / width).alias("slot"))
    moments = rows.select("device_name", "slot").distinct()
    near = rows.select("device_name", "us", "frame_id", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    away = F.abs(F.col("us") - F.col("slot") * width)
    on = (near["device_name"].eqNullSafe(moments["device_name"])) & (near["slot"] == moments["slot"])
    best = near.join(moments, on, "left_semi").groupBy("device_name", "slot").agg(F.min(F.struct(away.alias("away"), "frame_id")).alias("b"))
    return best.select("device_name", (F.col("slot") * width).alias("moment"), "b.frame_id", "b.away")


@_query(sql("tx su ma", "SELECT frame_id, place, id, confidence FROM (SELECT m.frame_id, t.id, t.confidence, row_number() OVER (PARTITION BY m.frame_id ORDER BY t.confidence DESC NULLS LAST, t.id) AS place FROM ma m JOIN su s USING (sub_frame_id) JOIN tx t ON t.sub_frame_id = s.sub_frame_id WHERE t.text <> '') WHERE place <= 5"))
def snapshot_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = domain.texts(spark, sf).where("text <> ''").select("sub_frame_id", "id", "confidence")
    rows = domain.mapping(spark, sf).join(domain.sub_frames(spark, sf).select("sub_frame_id"), "sub_frame_id").join(texts, "sub_frame_id")
    order = Window.partitionBy("frame_id").orderBy(F.desc_nulls_last("confidence"), "id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("frame_id", "place", "id", "confidence")


@_query(sql("asg ve", "SELECT key, app FROM ve WHERE key IN (SELECT sub_frame_id FROM asg WHERE label LIKE '%mail%')"))
def label_semi(spark: SparkSession, sf: str) -> DataFrame:
    wanted = domain.assignments(spark, sf).where("label LIKE '%mail%'").select(F.col("sub_frame_id").alias("key"))
    return domain.vectors(spark, sf).select("key", "app").join(wanted, "key", "left_semi")


@_query(sql("su asg", "SELECT sub_frame_id, app FROM su WHERE sub_frame_id NOT IN (SELECT sub_frame_id FROM asg)"))
def unassigned(spark: SparkSession, sf: str) -> DataFrame:
    return domain.sub_frames(spark, sf).select("sub_frame_id", "app").join(domain.assignments(spark, sf).select("sub_frame_id"), "sub_frame_id", "left_anti")


@_query(sql("su tx", "SELECT sub_frame_id, app FROM su WHERE sub_frame_id NOT IN (SELECT sub_frame_id FROM tx WHERE sub_frame_id IS NOT NULL AND trim(text) <> '')"))
def not_recognised(spark: SparkSession, sf: str) -> DataFrame:
    done = domain.texts(spark, sf).where("trim(text) <> ''").select("sub_frame_id")
    return domain.sub_frames(spark, sf).select("sub_frame_id", "app").join(done, "sub_frame_id", "left_anti")


@_query(sql("asg cl", "SELECT a.cluster_id, count(*) AS n, min(a.us) AS first_us FROM asg a LEFT JOIN cl c ON c.id = a.cluster_id WHERE a.cluster_id IS NOT NULL AND (c.id IS NULL OR c.status <> 'committed') GROUP BY 1"))
def stale_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments whose cluster is missing or not committed."""
    alive = domain.clusters(spark, sf).where("status = 'committed' OR status IS NULL").select(F.col("id").alias("cluster_id"))
    return domain.assignments(spark, sf).where("cluster_id IS NOT NULL").join(alive, "cluster_id", "left_anti").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))


_DEAD = """df AS (SELECT frame_id FROM fr WHERE video_chunk_id > 0 AND video_chunk_id NOT IN (SELECT id FROM video_chunks)),
    ds AS (SELECT sub_frame_id FROM ma GROUP BY sub_frame_id HAVING bool_and(frame_id IN (SELECT frame_id FROM df)))"""


def _dead(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf, "video_chunks").select(F.col("id").alias("video_chunk_id"))
    frames = domain.frames(spark, sf).where("video_chunk_id > 0").join(chunks, "video_chunk_id", "left_anti").select("frame_id")
    flagged = domain.mapping(spark, sf).join(frames.withColumn("dead", F.lit(True)), "frame_id", "left")
    subs = flagged.groupBy("sub_frame_id").agg(F.bool_and(F.coalesce("dead", F.lit(False))).alias("dead")).where("dead").select("sub_frame_id")
    return frames, subs


@_query(sql("fr ma", f"{_DEAD} ;; SELECT 'frame' AS what, frame_id AS key FROM df UNION ALL SELECT 'sub_frame', sub_frame_id FROM ds"))
def dead_references(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of missing chunks, and windows all of whose frames are such."""
    frames, subs = _dead(spark, sf)
    return frames.select(F.lit("frame").alias("what"), F.col("frame_id").alias("key")).unionByName(subs.select(F.lit("sub_frame").alias("what"), F.col("sub_frame_id").alias("key")))


@_query(sql("fr ma su tx", f"""{_DEAD} ;; SELECT 'frames' AS table_name, count(*) AS kept FROM fr WHERE frame_id NOT IN (SELECT frame_id FROM df) UNION ALL
    SELECT 'sub_frames', count(*) FROM su WHERE sub_frame_id NOT IN (SELECT sub_frame_id FROM ds) UNION ALL SELECT 'mapping', count(*) FROM ma WHERE frame_id NOT IN (SELECT frame_id FROM df) AND sub_frame_id NOT IN (SELECT sub_frame_id FROM ds) UNION ALL
    SELECT 'ocr_text', count(*) FROM tx WHERE (frame_id IS NULL OR frame_id NOT IN (SELECT frame_id FROM df)) AND (sub_frame_id IS NULL OR sub_frame_id NOT IN (SELECT sub_frame_id FROM ds))"""))
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of each table once dead frames and windows are removed, in dependency order."""
    frames, subs = _dead(spark, sf)
    kept = {
        "frames": domain.frames(spark, sf).select("frame_id").join(frames, "frame_id", "left_anti"),
        "sub_frames": domain.sub_frames(spark, sf).select("sub_frame_id").join(subs, "sub_frame_id", "left_anti"),
        "mapping": domain.mapping(spark, sf).join(frames, "frame_id", "left_anti").join(subs, "sub_frame_id", "left_anti"),
        "ocr_text": domain.texts(spark, sf).select("id", "frame_id", "sub_frame_id").join(frames, "frame_id", "left_anti").join(subs, "sub_frame_id", "left_anti"),
    }
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@_query(sql("su", "SELECT DISTINCT app, window_name FROM (SELECT app, window_name FROM su UNION ALL SELECT lower(trim(app_name)), window_name FROM window_chunks UNION ALL SELECT lower(trim(focused_app_name)), focused_window_name FROM frames) WHERE app <> '' AND window_name <> ''"))
def app_window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda df, a, w: df.select(F.lower(F.trim(a)).alias("app"), F.col(w).alias("window_name"))
    every = pair(domain.sub_frames(spark, sf), "app", "window_name").unionByName(pair(table(spark, sf, "window_chunks"), "app_name", "window_name")).unionByName(pair(table(spark, sf, "frames"), "focused_app_name", "focused_window_name"))
    return every.where("app <> '' AND window_name <> ''").distinct()


@_query(sql("su", "p AS (SELECT app FROM su WHERE app <> '' UNION SELECT lower(trim(app_name)) FROM window_chunks) ;; SELECT app, app IN (SELECT lower(trim(app_name)) FROM activity_clusters) AS clustered FROM p"))
def known_apps(spark: SparkSession, sf: str) -> DataFrame:
    apps = domain.sub_frames(spark, sf).where("app <> ''").select("app").union(table(spark, sf, "window_chunks").select(F.lower(F.trim("app_name")))).distinct()
    clustered = domain.clusters(spark, sf).select("app").distinct().withColumn("has", F.lit(True))
    return apps.join(clustered, "app", "left").select("app", F.coalesce("has", F.lit(False)).alias("clustered"))


@_query(sql("fr", "SELECT frame_id, device_name, monitor_id, (no - 1) // 60 AS chunk, (no - 1) % 60 AS position FROM (SELECT *, row_number() OVER (PARTITION BY device_name, monitor_id, us // 86400000000 ORDER BY us, frame_id) AS no FROM fr WHERE us IS NOT NULL)"))
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Count windows of 60 frames for each device, monitor and day: chunk and place in it."""
    no = F.row_number().over(Window.partitionBy("device_name", "monitor_id", F.floor(F.col("us") / DAY_US)).orderBy("us", "frame_id")) - 1
    rows = domain.frames(spark, sf).where("us IS NOT NULL").withColumn("no", no)
    return rows.select("frame_id", "device_name", "monitor_id", F.floor(F.col("no") / 60).alias("chunk"), (F.col("no") % 60).cast("long").alias("position"))


@_query(sql("fr", "n AS (SELECT frame_id, us, strftime(make_timestamp(us), '%Y%m%d_%H%M%S_%f') AS stamp, monitor_id FROM fr WHERE us IS NOT NULL) ;; SELECT frame_id, 'frame_' || stamp || '_' || coalesce(monitor_id, 0) || CASE WHEN row_number() OVER (PARTITION BY stamp, coalesce(monitor_id, 0) ORDER BY frame_id) > 1 THEN '_' || (row_number() OVER (PARTITION BY stamp, coalesce(monitor_id, 0) ORDER BY frame_id)) ELSE '' END AS new_id FROM n"))
def keys_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """A time-based key for every frame; frames of one moment and monitor are numbered."""
    us = F.col("us")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int"))
    second = F.floor(us / 1_000_000) % 86_400
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    stamp = F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), clock, F.lit("_"), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    rows = domain.frames(spark, sf).where("us IS NOT NULL").select("frame_id", stamp.alias("stamp"), F.coalesce("monitor_id", F.lit(0)).alias("monitor"))
    no = F.row_number().over(Window.partitionBy("stamp", "monitor").orderBy("frame_id"))
    tail = F.when(F.col("no") > 1, F.concat(F.lit("_"), F.col("no"))).otherwise("")
    return rows.withColumn("no", no).select("frame_id", F.concat(F.lit("frame_"), "stamp", F.lit("_"), "monitor", tail).alias("new_id"))


@_query(sql("", r"""n AS (SELECT DISTINCT window_name AS w FROM sub_frames WHERE window_name <> ''), c AS (SELECT w, regexp_replace(w, '[<>:"/\\|?*\x00-\x1f\s]', '_', 'g') AS s FROM n) ;; SELECT w AS window_name, CASE WHEN length(s) <= 50 THEN s ELSE left(s, 41) || '_' || left(md5(w), 8) END AS file_name FROM c"""))
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "sub_frames").where("window_name <> ''").select("window_name").distinct()
    return names.select("window_name", safe_name(F.col("window_name")).alias("file_name"))


@_query(sql("", "SELECT frame_id, CASE WHEN image_path LIKE '/%' OR image_path LIKE '%chunk:%' OR image_path = '' THEN image_path ELSE '/data/' || image_path END AS image_path FROM (SELECT DISTINCT frame_id, image_path FROM frames)"))
def absolute_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("image_path")
    kept = path.startswith("/") | path.contains("chunk:") | (path == "")
    return table(spark, sf, "frames").select("frame_id", "image_path").distinct().select("frame_id", F.when(path.isNull() | kept, path).otherwise(F.concat(F.lit("/data/"), path)).alias("image_path"))


@_query(sql("tx su", "b AS (SELECT s.device_name, sum(octet_length(encode(t.text)))::BIGINT AS bytes, count(*) AS texts FROM tx t JOIN su s USING (sub_frame_id) WHERE t.text IS NOT NULL GROUP BY 1) ;; SELECT device_name, texts, bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN format('{:.1f} KB', bytes / 1024.0) WHEN bytes < 1073741824 THEN format('{:.1f} MB', bytes / 1048576.0) ELSE format('{:.1f} GB', bytes / 1073741824.0) END AS size FROM b"))
def storage_size(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of recognised text that each device has stored, also in readable form."""
    subs = domain.sub_frames(spark, sf).select("sub_frame_id", "device_name")
    rows = domain.texts(spark, sf).where("text IS NOT NULL").select("sub_frame_id", F.octet_length("text").cast("long").alias("b")).join(subs, "sub_frame_id")
    return rows.groupBy("device_name").agg(F.count(F.lit(1)).alias("texts"), F.sum("b").alias("bytes")).withColumn("size", readable_size(F.col("bytes")))


@_query(sql("cl tx", "SELECT c.id, c.representative_frame_ids[1] AS frame FROM cl c LEFT JOIN (SELECT DISTINCT sub_frame_id FROM tx WHERE trim(text) <> '') t ON t.sub_frame_id = c.representative_frame_ids[1] WHERE t.sub_frame_id IS NULL"))
def textless_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters whose first representative has no recognised text."""
    read = domain.texts(spark, sf).where("trim(text) <> ''").select(F.col("sub_frame_id").alias("frame"))
    return domain.clusters(spark, sf).select("id", F.get("representative_frame_ids", F.lit(0)).alias("frame")).join(read, "frame", "left_anti").select("id", "frame")


@_query(sql("su", "SELECT app, sub_frame_id, us FROM su WHERE us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY app ORDER BY us DESC, sub_frame_id) <= 3"))
def latest_windows(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("app").orderBy(F.desc("us"), "sub_frame_id")
    return domain.sub_frames(spark, sf).where("us IS NOT NULL").withColumn("p", F.row_number().over(order)).where("p <= 3").select("app", "sub_frame_id", "us")
