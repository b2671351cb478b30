"""Time, app, activity and keyword analytics over the activity memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolens.functions.text import ASCII_TOKEN, STOP_WORDS, tokens
from chronolens.operators.focus import distractions, fragmented_hours, scores, streaks
from chronolens.operators.islands import islands
from chronolens.plans.prelude import sql
from chronolens.sources import domain
from chronolens.sources.tables import table

#: Parameters of the registered queries.
INTERVAL_S, DEEP_MINUTES, SHORT_MINUTES, BUSY_SWITCHES = 300, 20.0, 6.0, 3
START_US, END_US = 1_759_622_400_000_000, 1_762_214_400_000_000  # 2025-10-05 to 2025-11-04
DAY_US = 86_400_000_000

QUERIES: dict = {}
ORACLE: dict = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


_MAIN = f"us BETWEEN {START_US} AND {END_US}"


@_query(sql("fr", f"""g AS (SELECT app, count(*) AS n FROM fr WHERE {_MAIN} AND app <> '' GROUP BY app), r AS (SELECT app, n, round(n * {INTERVAL_S} / 60.0, 1) AS minutes FROM g) ;;
    SELECT app, n AS frames, minutes, round(n * 100.0 / sum(n) OVER (), 1) AS percentage, sum(minutes) OVER () AS total_minutes FROM r"""))
def app_focused_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.frames(spark, sf).where(f"{_MAIN} AND app <> ''").groupBy("app").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row an app
    rows = rows.select("app", F.col("n").alias("frames"), F.round(F.col("n") * INTERVAL_S / 60, 1).alias("minutes"), F.round(F.col("n") * 100.0 / F.sum("n").over(every), 1).alias("percentage"))
    return rows.withColumn("total_minutes", F.sum("minutes").over(every))


@_query(sql("fr", "SELECT min(us) AS first_us, max(us) AS last_us, (max(us) - min(us)) / 1e6 AS seconds, count(*) AS frames FROM fr"))
def recording_span(spark: SparkSession, sf: str) -> DataFrame:
    return domain.frames(spark, sf).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"), F.count(F.lit(1)).alias("frames"))


@_query(sql("fr", "SELECT device_name, min(us) AS first_us, arg_min(frame_id, (us, frame_id)) AS first_frame, max(us) AS last_us, arg_max(frame_id, (us, frame_id)) AS last_frame FROM fr WHERE frame_id LIKE 'frame_%' AND us IS NOT NULL GROUP BY device_name"))
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.frames(spark, sf).where("frame_id LIKE 'frame_%' AND us IS NOT NULL")
    at = F.struct("us", "frame_id")
    return rows.groupBy("device_name").agg(F.min("us").alias("first_us"), F.min_by("frame_id", at).alias("first_frame"), F.max("us").alias("last_us"), F.max_by("frame_id", at).alias("last_frame"))


@_query(sql("fr", f"SELECT us // {DAY_US} AS day, count(*) AS frames, count(DISTINCT device_name) AS devices FROM fr WHERE image_path <> '' AND us IS NOT NULL GROUP BY 1"))
def frames_on_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.frames(spark, sf).where("image_path <> '' AND us IS NOT NULL")
    return rows.groupBy(F.floor(F.col("us") / DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("device_name").alias("devices"))


@_query(sql("su", "SELECT app, window_name, count(*) AS n FROM su WHERE app <> '' AND window_name <> '' GROUP BY 1, 2 ORDER BY n DESC, app, window_name LIMIT 50"))
def window_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.sub_frames(spark, sf).where("app <> '' AND window_name <> ''").groupBy("app", "window_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "app", "window_name").limit(50)


@_query(sql("fr ma asg", f"SELECT a.label, count(DISTINCT f.frame_id) AS frames, round(count(DISTINCT f.frame_id) * {INTERVAL_S} / 60.0, 1) AS minutes FROM fr f JOIN ma m ON m.frame_id = f.frame_id JOIN asg a ON a.sub_frame_id = m.sub_frame_id AND a.app = lower(f.app) WHERE a.label <> '' GROUP BY 1"))
def activity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    f, m, a = domain.frames(spark, sf).select("frame_id", F.lower("app").alias("app")), domain.mapping(spark, sf), domain.assignments(spark, sf).where("label <> ''").select("sub_frame_id", "app", "label")
    return m.join(f, "frame_id").join(a, ["sub_frame_id", "app"]).groupBy("label").agg(F.countDistinct("frame_id").alias("frames")).select("label", "frames", F.round(F.col("frames") * INTERVAL_S / 60, 1).alias("minutes"))


_TOKENS = f"""tok AS (SELECT s.app, unnest(list_concat(list_filter(regexp_extract_all(t.text, '{ASCII_TOKEN}'), lambda w: lower(w) NOT IN ({", ".join(repr(w) for w in STOP_WORDS)}) AND length(w) <= 50), list_filter(regexp_extract_all(t.text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda w: w NOT IN ({", ".join(repr(w) for w in STOP_WORDS)})))) AS word
    FROM tx t JOIN su s ON s.sub_frame_id = t.sub_frame_id WHERE t.text <> '')"""


def _token_rows(spark: SparkSession, sf: str) -> DataFrame:
    subs = domain.sub_frames(spark, sf).select("sub_frame_id", "app")
    return domain.texts(spark, sf).where("text <> ''").select("sub_frame_id", "text").join(subs, "sub_frame_id").select("app", F.explode(tokens(F.col("text"))).alias("word"))


@_query(sql("tx su", f"{_TOKENS} ;; SELECT word, count(*) AS n, count(DISTINCT app) AS n_apps, string_agg(DISTINCT app, ',' ORDER BY app) AS apps FROM tok GROUP BY word ORDER BY n DESC, word LIMIT 100"))
def keywords_global(spark: SparkSession, sf: str) -> DataFrame:
    words = _token_rows(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("app")).alias("a"))
    return words.orderBy(F.desc("n"), "word").limit(100).select("word", "n", F.size("a").cast("long").alias("n_apps"), F.array_join("a", ",").alias("apps"))


@_query(sql("tx su", f"{_TOKENS}, c AS (SELECT app, word, count(*) AS n FROM tok WHERE app <> '' GROUP BY 1, 2) ;; SELECT app, word, n, place, app_total FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY n DESC, word) AS place, sum(n) OVER (PARTITION BY app)::BIGINT AS app_total FROM c) WHERE place <= 20"))
def keywords_per_app(spark: SparkSession, sf: str) -> DataFrame:
    words = _token_rows(spark, sf).where("app <> ''").groupBy("app", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = words.groupBy("app").agg(F.sum("n").alias("app_total"))
    top = words.withColumn("place", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("n"), "word")).cast("long")).where("place <= 20")
    return top.join(totals, "app").select("app", "word", "n", "place", "app_total")


@_query(sql("asg", "SELECT app, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'committed') AS committed, count(*) FILTER (status = 'expired') AS expired FROM asg GROUP BY app"))
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return domain.assignments(spark, sf).groupBy("app").agg(*map(of, ("pending", "candidate", "committed", "expired")))


@_query(sql("asg", "SELECT app, count(DISTINCT group_id) AS groups, count(*) AS members FROM asg WHERE status = 'pending' AND group_id IS NOT NULL GROUP BY app"))
def unresolved_groups(spark: SparkSession, sf: str) -> DataFrame:
    return domain.assignments(spark, sf).where("status = 'pending' AND group_id IS NOT NULL").groupBy("app").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("members"))


@_query(sql("asg", "SELECT app, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'candidate') AS candidate FROM asg GROUP BY app HAVING count(*) FILTER (status = 'pending') >= 50 OR count(*) FILTER (status = 'candidate') >= 50"))
def recalculation_due(spark: SparkSession, sf: str) -> DataFrame:
    return status_pivot(spark, sf).select("app", "pending", "candidate").where("pending >= 50 OR candidate >= 50")


@_query(sql("asg cl", "a AS (SELECT app, count(*) AS assigned FROM asg GROUP BY app), c AS (SELECT app, count(*) AS clusters, coalesce(sum(frame_count), 0)::BIGINT AS claimed FROM cl GROUP BY app) ;; SELECT coalesce(a.app, c.app) AS app, coalesce(assigned, 0) AS assigned, coalesce(clusters, 0) AS clusters, coalesce(claimed, 0) AS claimed FROM a FULL JOIN c ON a.app = c.app"))
def cluster_debug(spark: SparkSession, sf: str) -> DataFrame:
    a = domain.assignments(spark, sf).groupBy("app").agg(F.count(F.lit(1)).alias("assigned"))
    c = domain.clusters(spark, sf).groupBy("app").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("claimed"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return a.join(c, "app", "full").select("app", zero("assigned"), zero("clusters"), zero("claimed"))


@_query(sql("", "SELECT 'frames' AS what, count(*) AS n FROM frames UNION ALL SELECT 'sub_frames', count(*) FROM sub_frames UNION ALL SELECT 'ocr_text', count(*) FROM ocr_text UNION ALL SELECT 'video_chunks', count(*) FROM video_chunks UNION ALL SELECT 'window_chunks', count(*) FROM window_chunks UNION ALL SELECT 'text_length', coalesce(sum(text_length), 0)::BIGINT FROM ocr_text UNION ALL SELECT 'vectors', count(*) FILTER (embedding IS NOT NULL) FROM sub_frame_data"))
def storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("frames", "sub_frames", "ocr_text", "video_chunks", "window_chunks"):
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    length = table(spark, sf, "ocr_text").agg(F.coalesce(F.sum("text_length"), F.lit(0)).alias("n")).select(F.lit("text_length").alias("what"), "n")
    vectors = table(spark, sf, "sub_frame_data").agg(F.count("embedding").alias("n")).select(F.lit("vectors").alias("what"), "n")
    return out.unionByName(length).unionByName(vectors)


@_query(sql("tx", "SELECT sub_frame_id, coalesce(round(sum(n * confidence) FILTER (confidence IS NOT NULL) / nullif(sum(n) FILTER (confidence IS NOT NULL), 0), 6), 0) AS confidence, sum(n)::BIGINT AS length FROM tx WHERE sub_frame_id IS NOT NULL AND text IS NOT NULL GROUP BY 1"))
def weighted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.texts(spark, sf).where("sub_frame_id IS NOT NULL AND text IS NOT NULL")
    known = F.when(F.col("confidence").isNotNull(), F.col("n"))
    mean = F.sum(known * F.col("confidence")) / F.when(F.sum(known) > 0, F.sum(known))
    return rows.groupBy("sub_frame_id").agg(F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("confidence"), F.sum("n").alias("length"))


@_query(sql("tx su ma", "b AS (SELECT m.frame_id, s.app, string_agg(t.text, chr(10) ORDER BY t.id) AS block FROM ma m JOIN su s USING (sub_frame_id) JOIN tx t ON t.sub_frame_id = s.sub_frame_id WHERE trim(t.text) <> '' AND s.app <> '' GROUP BY 1, 2) ;; SELECT frame_id, md5(string_agg('[' || app || ']' || chr(10) || block, chr(10) ORDER BY app)) AS text_md5, count(*) AS apps FROM b GROUP BY 1"))
def combined_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's texts by app, as ``[app]`` blocks; compared by hash, so whole texts count."""
    rows = domain.mapping(spark, sf).join(domain.sub_frames(spark, sf).where("app <> ''").select("sub_frame_id", "app"), "sub_frame_id").join(domain.texts(spark, sf).where("trim(text) <> ''").select("sub_frame_id", "id", "text"), "sub_frame_id")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]]), "\n")
    blocks = rows.groupBy("frame_id", "app").agg(joined(["id", "text"]).alias("block"))
    blocks = blocks.select("frame_id", "app", F.concat(F.lit("["), "app", F.lit("]\n"), "block").alias("whole"))
    return blocks.groupBy("frame_id").agg(F.md5(joined(["app", "whole"])).alias("text_md5"), F.count(F.lit(1)).alias("apps"))


@_query(sql("tx", "SELECT sub_frame_id, arg_max(id, (n, id)) AS id, max(n) AS n FROM tx WHERE sub_frame_id IS NOT NULL AND text <> '' GROUP BY 1"))
def longest_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.texts(spark, sf).where("sub_frame_id IS NOT NULL AND text <> ''")
    return rows.groupBy("sub_frame_id").agg(F.max_by("id", F.struct("n", "id")).alias("id"), F.max("n").alias("n"))


@_query(sql("", """w AS (SELECT id, unnest(from_json(text_json, '[{"t": "VARCHAR", "c": "DOUBLE"}]')) AS x FROM (SELECT DISTINCT id, text_json FROM ocr_text WHERE json_valid(text_json))) ;; SELECT lower(x.t) AS word, count(*) AS n, round(avg(x.c), 6) AS confidence FROM w GROUP BY 1"""))
def recognised_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ocr_text").select("id", "text_json").distinct()
    words = rows.select(F.explode(F.from_json("text_json", "array<struct<t: string, c: double>>")).alias("x"))
    return words.groupBy(F.lower("x.t").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.c"), 6).alias("confidence"))


_STREAK = f"""m AS (SELECT device_name, us // {DAY_US} AS day, app, us, frame_id, CASE WHEN app IS DISTINCT FROM lag(app) OVER w THEN 1 ELSE 0 END AS fresh FROM fr WHERE app <> '' AND us IS NOT NULL WINDOW w AS (PARTITION BY device_name, us // {DAY_US} ORDER BY us, frame_id)),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY device_name, day ORDER BY us, frame_id ROWS UNBOUNDED PRECEDING) AS no FROM m),
    st AS (SELECT device_name, day, min(app) AS app, min(us) AS start_us, max(us) AS end_us, count(*) AS n, count(*) * {INTERVAL_S} / 60.0 AS minutes FROM k GROUP BY device_name, day, no)"""


def _streaks(spark: SparkSession, sf: str) -> DataFrame:
    return streaks(domain.frames(spark, sf), INTERVAL_S)


@_query(sql("fr", f"{_STREAK} ;; SELECT device_name, day, app, start_us, end_us, n, minutes::DOUBLE AS minutes FROM st"))
def focus_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return _streaks(spark, sf)


@_query(sql("fr", f"{_STREAK} ;; SELECT device_name, day, count(*) - 1 AS switches FROM st GROUP BY 1, 2"))
def switch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _streaks(spark, sf).groupBy("device_name", "day").agg((F.count(F.lit(1)) - 1).alias("switches"))


@_query(sql("fr", f"{_STREAK} ;; SELECT device_name, day, app, start_us, end_us, minutes::DOUBLE AS minutes FROM st WHERE minutes >= {DEEP_MINUTES}"))
def deep_work(spark: SparkSession, sf: str) -> DataFrame:
    return _streaks(spark, sf).where(F.col("minutes") >= DEEP_MINUTES).select("device_name", "day", "app", "start_us", "end_us", "minutes")


@_query(sql("fr", f"{_STREAK} ;; SELECT device_name, (start_us // 3600000000) * 3600000000 AS hour_us, count(*) AS switches FROM (SELECT *, row_number() OVER (PARTITION BY device_name, day ORDER BY start_us) AS k FROM st) WHERE k > 1 GROUP BY 1, 2 HAVING count(*) >= {BUSY_SWITCHES}"))
def fragmented(spark: SparkSession, sf: str) -> DataFrame:
    return fragmented_hours(_streaks(spark, sf), BUSY_SWITCHES)


@_query(sql("fr", f"{_STREAK}, c AS (SELECT device_name, day, app, count(*) AS short_streaks, min(start_us) AS f FROM st WHERE minutes < {SHORT_MINUTES} GROUP BY 1, 2, 3) ;; SELECT device_name, day, app, short_streaks, place FROM (SELECT *, row_number() OVER (PARTITION BY device_name, day ORDER BY short_streaks DESC, f, app) AS place FROM c) WHERE place <= 5"))
def distraction_apps(spark: SparkSession, sf: str) -> DataFrame:
    return distractions(_streaks(spark, sf), SHORT_MINUTES)


@_query(sql("fr", f"""{_STREAK}, d AS (SELECT device_name, day, sum(minutes)::DOUBLE AS total, coalesce(sum(minutes) FILTER (minutes >= {DEEP_MINUTES}), 0)::DOUBLE AS deep, max(minutes)::DOUBLE AS longest, avg(minutes::DOUBLE) AS average, count(*) - 1 AS switches FROM st GROUP BY 1, 2) ;;
    SELECT device_name, day, round_even(round(40 * least(deep / total, 1) + 30 * greatest(0, 1 - switches / (total / 60) / 30) + 30 * least(longest / 60, 1), 6), 0)::BIGINT AS score, round(total, 3) AS total_minutes, round(deep, 3) AS deep_minutes, round(longest, 3) AS longest_minutes, round(average, 3) AS average_minutes, switches, round(switches / (total / 60), 3) AS switches_an_hour FROM d"""))
def focus_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores(_streaks(spark, sf), DEEP_MINUTES)


_SESSION = """q AS (SELECT a.*, s.device_name FROM asg a LEFT JOIN su s USING (sub_frame_id) WHERE cluster_id IS NOT NULL AND a.us IS NOT NULL),
    m2 AS (SELECT *, CASE WHEN cluster_id IS DISTINCT FROM lag(cluster_id) OVER w THEN 1 ELSE 0 END AS fresh FROM q WINDOW w AS (PARTITION BY device_name, app ORDER BY us, sub_frame_id)),
    k2 AS (SELECT *, sum(fresh) OVER (PARTITION BY device_name, app ORDER BY us, sub_frame_id ROWS UNBOUNDED PRECEDING) AS no FROM m2),
    i2 AS (SELECT device_name, app, min(cluster_id) AS cluster_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n, no FROM k2 GROUP BY device_name, app, no),
    se AS (SELECT device_name, app, cluster_id, start_us, coalesce(lead(start_us) OVER (PARTITION BY device_name, app ORDER BY no), last_us) AS end_us, n FROM i2)"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by device and app; captures without a row of their own belong to no device."""
    rows = domain.assignments(spark, sf).where("cluster_id IS NOT NULL").select("app", "us", "sub_frame_id", "cluster_id")
    rows = rows.join(domain.sub_frames(spark, sf).select("sub_frame_id", "device_name"), "sub_frame_id", "left")
    return islands(rows, ["device_name", "app"], "cluster_id", "sub_frame_id").select("device_name", "app", "cluster_id", "start_us", F.coalesce("next_us", "end_us").alias("end_us"), "n")


@_query(sql("asg su", f"{_SESSION} ;; SELECT device_name, app, cluster_id, start_us, end_us, n FROM se"))
def sessions_offline(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one cluster in a device's app; a session lasts until the next one starts."""
    return _sessions(spark, sf)


@_query(sql("asg cl su", f"{_SESSION} ;; SELECT s.device_name, s.app, c.label, greatest(start_us, {START_US}) AS start_us, least(end_us, {END_US}) AS end_us, round((least(end_us, {END_US}) - greatest(start_us, {START_US})) / 1e6)::BIGINT AS seconds FROM se s JOIN cl c ON c.id = s.cluster_id WHERE c.status = 'committed' AND end_us >= {START_US} AND start_us <= {END_US}"))
def timeline_clipped(spark: SparkSession, sf: str) -> DataFrame:
    names = domain.clusters(spark, sf).where("status = 'committed'").select(F.col("id").alias("cluster_id"), "label")
    inside = _sessions(spark, sf).where(f"end_us >= {START_US} AND start_us <= {END_US}").join(names, "cluster_id")
    start, end = F.greatest("start_us", F.lit(START_US)), F.least("end_us", F.lit(END_US))
    return inside.select("device_name", "app", "label", start.alias("start_us"), end.alias("end_us"), F.round((end - start) / 1e6).cast("long").alias("seconds"))


@_query(sql("asg cl su", f"{_SESSION}, d AS (SELECT s.app, c.label, sum(end_us - start_us)::BIGINT AS us FROM se s JOIN cl c ON c.id = s.cluster_id WHERE c.label <> '' GROUP BY 1, 2) ;; SELECT app, label, us, place FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY us DESC, label) AS place FROM d) WHERE place <= 5"))
def label_totals(spark: SparkSession, sf: str) -> DataFrame:
    names = domain.clusters(spark, sf).where("label <> ''").select(F.col("id").alias("cluster_id"), "label")
    totals = _sessions(spark, sf).join(names, "cluster_id").groupBy("app", "label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("us"), "label")).cast("long")).where("place <= 5")


@_query(sql("asg", "SELECT app, label, count(*) AS n FROM asg WHERE label IS NOT NULL AND label NOT LIKE 'unknown%' AND label NOT LIKE '%_activity_%' AND length(label) BETWEEN 2 AND 60 GROUP BY 1, 2"))
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return domain.assignments(spark, sf).where("label IS NOT NULL AND label NOT LIKE 'unknown%' AND label NOT LIKE '%_activity_%' AND length(label) BETWEEN 2 AND 60").groupBy("app", "label").agg(F.count(F.lit(1)).alias("n"))


@_query(sql("cl", "SELECT DISTINCT app FROM cl WHERE status = 'committed'"))
def committed_apps(spark: SparkSession, sf: str) -> DataFrame:
    return domain.clusters(spark, sf).where("status = 'committed'").select("app").distinct()


@_query(sql("su asg", "SELECT s.app, count(*) AS captures, count(*) FILTER (a.sub_frame_id IS NULL) AS uncovered, max(a.us) AS last_us, count(*) FILTER (a.sub_frame_id IS NULL) > 20 AS unhealthy FROM su s LEFT JOIN asg a USING (sub_frame_id) GROUP BY s.app"))
def clustering_health(spark: SparkSession, sf: str) -> DataFrame:
    a = domain.assignments(spark, sf).select("sub_frame_id", F.col("us").alias("a_us"))
    rows = domain.sub_frames(spark, sf).select("sub_frame_id", "app").join(a.withColumn("has", F.lit(True)), "sub_frame_id", "left")
    bare = F.count(F.when(F.col("has").isNull(), 1))
    return rows.groupBy("app").agg(F.count(F.lit(1)).alias("captures"), bare.alias("uncovered"), F.max("a_us").alias("last_us"), (bare > 20).alias("unhealthy"))


@_query(sql("", "SELECT device_name, monitor_id, max(id) AS id, count(*) AS chunks, coalesce(sum(frame_count), 0)::BIGINT AS frames FROM video_chunks GROUP BY 1, 2"))
def latest_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "video_chunks").groupBy("device_name", "monitor_id").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"))


@_query()
def write_delay(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from capture to the stored vector, by app: count, mean, least, most, and a 95th
    percentile whose rank is off by a ten thousandth at most (a sketch of bounded size)."""
    stored = table(spark, sf, "sub_frame_data").groupBy(F.col("frame_id").alias("sub_frame_id")).agg(F.min(F.unix_micros("timestamp")).alias("stored_us"))
    rows = domain.sub_frames(spark, sf).select("sub_frame_id", "app", "us").join(stored, "sub_frame_id").where("us IS NOT NULL AND stored_us IS NOT NULL").select("app", ((F.col("stored_us") - F.col("us")) / 1e6).alias("s"))
    return rows.groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_s"), F.min("s").alias("least_s"), F.max("s").alias("most_s"), (F.approx_percentile("s", 0.95, 10_000)).alias("p95_s"))


ORACLE["write_delay"] = sql("su", "d AS (SELECT s.app, (v.stored_us - s.us) / 1e6 AS s FROM su s JOIN (SELECT frame_id, min(epoch_us(timestamp)) AS stored_us FROM sub_frame_data GROUP BY 1) v ON v.frame_id = s.sub_frame_id WHERE s.us IS NOT NULL AND v.stored_us IS NOT NULL) ;; SELECT app, count(*) AS n, round(avg(s), 6) AS mean_s, min(s) AS least_s, max(s) AS most_s, quantile_disc(s, 0.95) AS p95_s FROM d GROUP BY app")
