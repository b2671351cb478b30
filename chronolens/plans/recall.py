"""Finding moments again: phrases, search modes, fallbacks, tiers, purposes, rebuild points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolens.functions.text import plain_label
from chronolens.operators.islands import islands
from chronolens.operators.search import fuse_ranks, nearest_rows, search_by
from chronolens.plans.analytics import _SESSION, DAY_US, END_US, INTERVAL_S, START_US
from chronolens.plans.prelude import sql
from chronolens.plans.search import _BM25, _DENSE, _TWO, K, _lists, _probe
from chronolens.sources import domain
from chronolens.sources.tables import table

PHRASE, CUT_US, SAMPLES = "quarterly harbour report", 1_760_918_400_000_000, 20  # rows before 2025-10-20 count as built
#: Words that ask for an exact match.
EXACT_WORDS = ["error", "warning", "exception", "git", "command", "def ", "class "]

QUERIES: dict = {}
ORACLE: dict = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


_FULL = "(own_app IS NULL OR own_app = '')"


@_query(sql("fr tx", f"SELECT f.frame_id, f.us, f.app, t.id AS text_id FROM fr f LEFT JOIN tx t ON t.frame_id = f.frame_id WHERE {_FULL} AND f.us >= {START_US} AND f.us < {END_US}"))
def full_screen_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of the full screen in a time range, with their texts."""
    texts = domain.texts(spark, sf).where("frame_id IS NOT NULL").select("frame_id", F.col("id").alias("text_id"))
    return domain.frames(spark, sf).where(f"{_FULL} AND us >= {START_US} AND us < {END_US}").select("frame_id", "us", "app").join(texts, "frame_id", "left")


def _holds_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` one after the other, whatever is between them."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")


_PHRASE = rf"(' ' || array_to_string(list_filter(string_split_regex(lower(t.text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ') LIKE '% {PHRASE} %'"


@_query(sql("tx fr", f"SELECT t.id, t.frame_id, f.us, f.app, t.confidence FROM tx t JOIN fr f ON f.frame_id = t.frame_id WHERE {_PHRASE}"))
def phrase_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose text holds a phrase."""
    hits = domain.texts(spark, sf).where(_holds_phrase(F.col("text"), PHRASE)).select("id", "frame_id", "confidence")
    return hits.join(domain.frames(spark, sf).select("frame_id", "us", "app"), "frame_id").select("id", "frame_id", "us", "app", "confidence")


@_query(sql("tx su", f"SELECT t.id, sub_frame_id, s.us, s.app, s.window_name FROM tx t JOIN su s USING (sub_frame_id) WHERE {_PHRASE}"))
def phrase_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows whose text holds a phrase."""
    hits = domain.texts(spark, sf).where(_holds_phrase(F.col("text"), PHRASE)).select("id", "sub_frame_id")
    return hits.join(domain.sub_frames(spark, sf).select("sub_frame_id", "us", "app", "window_name"), "sub_frame_id").select("id", "sub_frame_id", "us", "app", "window_name")


_RRF = f"(SELECT key FROM (SELECT key, 60 + place AS p FROM dl UNION ALL SELECT key, 60 + place FROM sl) GROUP BY key ORDER BY round(sum(1.0 / p), 9) DESC, key LIMIT {K})"


@_query(sql("ve tx", f"{_TWO} ;; SELECT 'dense' AS mode, key FROM (SELECT key FROM dl ORDER BY place LIMIT {K}) UNION ALL SELECT 'sparse', key FROM (SELECT key FROM sl ORDER BY place LIMIT {K}) UNION ALL SELECT 'hybrid', key FROM {_RRF}"))
def search_modes(spark: SparkSession, sf: str) -> DataFrame:
    """One search in every mode; an unknown mode finds nothing."""
    dense, sparse = _lists(spark, sf)
    lists = {"dense": lambda: dense.orderBy("distance", "key").limit(K), "sparse": lambda: sparse.orderBy(F.desc("score"), "key").limit(K), "hybrid": lambda: fuse_ranks(dense, sparse, K)}
    out = None
    for mode in (*lists, "other"):
        one = search_by(mode, lists, spark).select(F.lit(mode).alias("mode"), "key")
        out = one if out is None else out.unionByName(one)
    return out


_FALL = _DENSE.format(where="") + ", " + _BM25 + ", sl AS (SELECT sub_frame_id AS key, max(score) AS score FROM bm JOIN d USING (id) GROUP BY 1 ORDER BY score DESC, key LIMIT 50)"


def _fallback_sql(app: str) -> str:
    dense = f"SELECT '{app}' AS app, 'dense' AS by, key FROM (SELECT key FROM de WHERE app = '{app}' ORDER BY distance, key LIMIT {K})"
    return f"{dense} UNION ALL SELECT '{app}', 'words', key FROM (SELECT key FROM sl ORDER BY score DESC, key LIMIT {K}) WHERE NOT EXISTS (SELECT 1 FROM de WHERE app = '{app}')"


@_query(sql("ve tx", f"{_FALL} ;; {_fallback_sql('tern mail')} UNION ALL {_fallback_sql('no such app')}"))
def search_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Vector search within an app; where it finds nothing, the word search answers."""
    _, sparse = _lists(spark, sf)
    out = None
    for app in ("tern mail", "no such app"):
        dense = nearest_rows(domain.vectors(spark, sf), _probe(spark, sf), K, F.col("app") == app).select("key")
        found = dense.agg(F.count(F.lit(1)).alias("__n"))  # one row
        words = sparse.orderBy(F.desc("score"), "key").limit(K).select("key").join(F.broadcast(found), F.lit(True)).where("__n = 0")
        one = dense.select(F.lit(app).alias("app"), F.lit("dense").alias("by"), "key").unionByName(words.select(F.lit(app).alias("app"), F.lit("words").alias("by"), "key"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(sql("ve tx", f"""{_TWO}, pa AS (SELECT frame_id AS key, min(image_path) AS image_path FROM sub_frame_data WHERE image_path <> '' GROUP BY 1), two AS (SELECT image_path, max(score) AS score FROM sl JOIN pa USING (key) GROUP BY 1),
    hit AS (SELECT dl.key, image_path, dl.place, two.score FROM dl JOIN pa USING (key) LEFT JOIN two USING (image_path)) ;; SELECT key, image_path, score FROM (SELECT * FROM hit WHERE score IS NOT NULL OR NOT EXISTS (SELECT 1 FROM two)) ORDER BY place LIMIT {K}"""))
def hits_on_one_picture(spark: SparkSession, sf: str) -> DataFrame:
    """Vector hits, in their order, whose picture the word search found too; all of them if it found none."""
    dense, sparse = _lists(spark, sf)
    paths = table(spark, sf, "sub_frame_data").where("image_path <> ''").groupBy(F.col("frame_id").alias("key")).agg(F.min("image_path").alias("image_path"))
    two = sparse.join(paths, "key").groupBy("image_path").agg(F.max("score").alias("score"))
    found = two.agg(F.count(F.lit(1)).alias("__n"))  # one row
    hit = dense.join(paths, "key").join(two, "image_path", "left").join(F.broadcast(found), F.lit(True)).where("score IS NOT NULL OR __n = 0")
    return hit.orderBy("distance", "key").limit(K).select("key", "image_path", "score")


_STAMPS = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)"


@_query(sql("tx", rf"m AS (SELECT id, list_transform(regexp_extract_all(text, '{_STAMPS}'), lambda x: epoch_us(try_cast(x AS TIMESTAMP))) AS m FROM tx WHERE text <> 'null') ;; SELECT id, least(m[1], m[2]) AS start_us, greatest(m[1], m[2]) AS end_us FROM m WHERE m[1] IS NOT NULL AND m[2] IS NOT NULL"))
def ranges_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The time range that a text names: its first two moments (taken as UTC), the earlier one first."""
    found = F.regexp_extract_all("text", F.lit(_STAMPS), F.lit(1))
    us = lambda i: F.unix_micros(F.concat(F.rpad(F.get(found, F.lit(i)), 19, ":00"), F.lit("+00:00")).try_cast("timestamp"))
    rows = domain.texts(spark, sf).where("text <> 'null'").select("id", us(0).alias("a"), us(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select("id", F.least("a", "b").alias("start_us"), F.greatest("a", "b").alias("end_us"))


_SECOND, _MINUTE = 1_000_000, 60_000_000


@_query(sql("fr", f"""mo AS (SELECT DISTINCT device_name, id, epoch_us(created_at) AS us FROM video_chunks WHERE created_at IS NOT NULL),
    f AS (SELECT device_name, us, frame_id FROM fr WHERE us IS NOT NULL AND {_FULL}),
    k AS (SELECT device_name, 1 AS tier, us // {_SECOND} AS k, us, frame_id FROM f UNION ALL SELECT device_name, 2, us // {_MINUTE}, us, frame_id FROM f UNION ALL SELECT device_name, 3, us // {_MINUTE}, us, frame_id FROM f),
    b AS (SELECT device_name, tier, k, min({{'us': us, 'frame_id': frame_id}}) AS b FROM k GROUP BY 1, 2, 3),
    a AS (SELECT device_name, id, us AS moment, 1 AS tier, us // {_SECOND} AS k FROM mo UNION ALL SELECT device_name, id, us, 2, us // {_MINUTE} FROM mo UNION ALL SELECT device_name, id, us, 3, us // {DAY_US} * 1440 + (us // {_MINUTE} - 480) % 1440 + CASE WHEN (us // {_MINUTE} - 480) % 1440 < 0 THEN 1440 ELSE 0 END FROM mo) ;;
    SELECT id, moment, tier, b.frame_id AS frame_id FROM (SELECT a.id, a.moment, a.tier, b.b FROM a JOIN b ON b.device_name = a.device_name AND b.tier = a.tier AND b.k = a.k) QUALIFY row_number() OVER (PARTITION BY id, moment ORDER BY tier, b.us, b.frame_id) = 1"""))
def frames_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    """For each chunk's moment the first full-screen frame of its device in the same second, else the
    same minute, else that minute eight hours earlier on the clock of the same day."""
    tiers = lambda second, minute, other: F.array(*[F.struct(F.lit(t).alias("tier"), k.cast("long").alias("k")) for t, k in ((1, second), (2, minute), (3, other))])
    us = F.col("us")
    second, minute = F.floor(us / _SECOND), F.floor(us / _MINUTE)
    frames = domain.frames(spark, sf).where(f"us IS NOT NULL AND {_FULL}").select("device_name", "us", "frame_id", F.explode(tiers(second, minute, minute)).alias("t"))
    first = frames.groupBy("device_name", "t").agg(F.min(F.struct("us", "frame_id")).alias("b"))
    moments = table(spark, sf, "video_chunks").select("device_name", "id", F.unix_micros("created_at").alias("us")).where("us IS NOT NULL").distinct()
    earlier = F.floor(us / DAY_US) * 1_440 + F.pmod(minute - 480, F.lit(1_440))
    asked = moments.select("device_name", "id", F.col("us").alias("moment"), F.explode(tiers(second, minute, earlier)).alias("t"))
    best = asked.join(first, ["device_name", "t"]).groupBy("id", "moment").agg(F.min(F.struct("t.tier", "b")).alias("m"))
    return best.select("id", "moment", F.col("m.tier").alias("tier"), F.col("m.b.frame_id").alias("frame_id"))


@_query(sql("fr", f"""u AS (SELECT app, count(*) AS n FROM fr WHERE app <> '' GROUP BY 1), p AS (SELECT trim(app_name) AS app, string_agg(DISTINCT trim(label), ', ' ORDER BY trim(label)) AS words FROM activity_clusters WHERE trim(app_name) <> '' AND trim(label) <> '' GROUP BY 1),
    q AS (SELECT lower(app) AS low, arg_min(words, app) AS words FROM p GROUP BY 1) ;; SELECT u.app, n AS frames, round(n * {INTERVAL_S} / 60.0, 1) AS minutes, coalesce(p.words, q.words, '') AS purposes FROM u LEFT JOIN p ON p.app = u.app LEFT JOIN q ON q.low = lower(u.app)"""))
def usage_with_purposes(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of each app with its known activities: those of the app as written, else in any case."""
    usage = domain.frames(spark, sf).where("app <> ''").groupBy("app").agg(F.count(F.lit(1)).alias("frames"))
    known = table(spark, sf, "activity_clusters").select(F.trim("app_name").alias("app"), F.trim("label").alias("label")).where("app <> '' AND label <> ''")
    known = known.groupBy("app").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("exact"))
    folded = known.groupBy(F.lower("app").alias("low")).agg(F.min_by("exact", "app").alias("other"))
    rows = usage.join(known, "app", "left").withColumn("low", F.lower("app")).join(folded, "low", "left")
    return rows.select("app", "frames", F.round(F.col("frames") * INTERVAL_S / 60, 1).alias("minutes"), F.coalesce("exact", "other", F.lit("")).alias("purposes"))


@_query(sql("asg su", f"""{_SESSION.replace('WHERE cluster_id IS NOT NULL', f"WHERE a.us < {CUT_US} AND status = 'committed' AND cluster_id IS NOT NULL")},
    l AS (SELECT device_name, app, max({{'e': end_us, 's': start_us}}) AS l FROM se GROUP BY 1, 2), c AS (SELECT s.device_name, a.app, min(a.us) AS first_us, max(a.us) AS last_us FROM asg a LEFT JOIN su s USING (sub_frame_id) WHERE cluster_id IS NOT NULL AND status = 'committed' AND a.us IS NOT NULL GROUP BY 1, 2) ;;
    SELECT c.device_name, c.app, CASE WHEN l.l IS NULL THEN first_us ELSE l.l.s END AS rebuild_us FROM c LEFT JOIN l ON l.device_name IS NOT DISTINCT FROM c.device_name AND l.app IS NOT DISTINCT FROM c.app WHERE l.l IS NULL OR c.last_us > l.l.e"""))
def rebuild_points(spark: SparkSession, sf: str) -> DataFrame:
    """From where each device's app has to be rebuilt, if what lies before CUT_US is built: its last
    session's start if newer rows exist, its first row if nothing is built, else it is left out."""
    rows = domain.assignments(spark, sf).where("cluster_id IS NOT NULL AND status = 'committed' AND us IS NOT NULL").select("app", "us", "sub_frame_id", "cluster_id")
    rows = rows.join(domain.sub_frames(spark, sf).select("sub_frame_id", "device_name"), "sub_frame_id", "left")
    built = islands(rows.where(F.col("us") < CUT_US), ["device_name", "app"], "cluster_id", "sub_frame_id")
    last = built.groupBy("device_name", "app").agg(F.max(F.struct(F.coalesce("next_us", "end_us").alias("e"), F.col("start_us").alias("s"))).alias("l"))
    every = rows.groupBy("device_name", "app").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    a, b = every.alias("a"), last.alias("b")
    both = a.join(b, F.col("a.device_name").eqNullSafe(F.col("b.device_name")) & F.col("a.app").eqNullSafe(F.col("b.app")), "left")
    return both.where("l IS NULL OR last_us > l.e").select("a.device_name", "a.app", F.coalesce("l.s", "first_us").alias("rebuild_us"))


_TARGET = r"tg AS (SELECT c.id, t.id AS target_id, t.label AS target_label FROM cl c JOIN (SELECT app, regexp_replace(label, '[^\p{L}\p{N}]', '', 'g') AS plain, min(id) AS id, arg_min(label, {'id': id, 'label': label}) AS label FROM cl WHERE label <> '' GROUP BY 1, 2) t ON t.app = c.app AND t.plain = regexp_replace(c.label, '[^\p{L}\p{N}]', '', 'g') WHERE c.label <> '')"


@_query(sql("asg cl", f"{_TARGET}, one AS (SELECT id, min({{'t': target_id, 'l': target_label}}) AS m FROM tg GROUP BY 1) ;; SELECT sub_frame_id, coalesce(m.t, cluster_id) AS cluster_id, coalesce(m.l, label) AS label FROM asg LEFT JOIN one ON one.id = asg.cluster_id"))
def assignments_repointed(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments after clusters of an app whose labels mean the same were merged into the oldest."""
    named = domain.clusters(spark, sf).where("label <> ''").select("id", "app", "label", plain_label(F.col("label")).alias("plain"))
    oldest = named.groupBy("app", "plain").agg(F.min(F.struct("id", "label")).alias("t"))
    moves = named.join(oldest, ["app", "plain"]).groupBy(F.col("id").alias("cluster_id")).agg(F.min(F.struct(F.col("t.id").alias("t"), F.col("t.label").alias("l"))).alias("m"))
    return domain.assignments(spark, sf).join(moves, "cluster_id", "left").select("sub_frame_id", F.coalesce("m.t", "cluster_id").alias("cluster_id"), F.coalesce("m.l", "label").alias("label"))


@_query(sql("cl", f"{_TARGET}, c AS (SELECT target_id, count(DISTINCT tg.id) AS merged, coalesce(sum(frame_count), 0)::BIGINT AS frames FROM (SELECT DISTINCT id, target_id FROM tg) tg JOIN (SELECT id, max(frame_count) AS frame_count FROM cl GROUP BY 1) z USING (id) GROUP BY 1) ;; SELECT * FROM c"))
def clusters_after_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters that stay after the merge, with how many they took in and the frames of all."""
    rows = domain.clusters(spark, sf)
    named = rows.where("label <> ''").select("id", "app", plain_label(F.col("label")).alias("plain"))
    oldest = named.groupBy("app", "plain").agg(F.min("id").alias("target_id"))
    counts = rows.groupBy("id").agg(F.max("frame_count").alias("frame_count"))
    return named.join(oldest, ["app", "plain"]).join(counts, "id").groupBy("target_id").agg(F.countDistinct("id").alias("merged"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"))


@_query("SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, lag(value) OVER w AS before, row_number() OVER w AS no FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)) WHERE no = 1 OR abs(value - before) > 5")
def changed_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value differs by more than 5 from the event before, and the first of each type and day."""
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = table(spark, sf, "events").where("value IS NOT NULL").withColumn("before", F.lag("value").over(order)).withColumn("no", F.row_number().over(order))
    return rows.where((F.col("no") == 1) | (F.abs(F.col("value") - F.col("before")) > 5)).select("event_type", "event_id", "value")


@_query(sql("fr", f"""n AS (SELECT *, row_number() OVER (PARTITION BY device_name, us // {DAY_US} ORDER BY us, frame_id) - 1 AS no, count(*) OVER (PARTITION BY device_name, us // {DAY_US}) AS n FROM fr WHERE us IS NOT NULL),
    s AS (SELECT device_name, us // {DAY_US} AS day, frame_id, us, no // greatest(1, n // {SAMPLES}) AS place FROM n WHERE n <= {SAMPLES} OR no % (n // {SAMPLES}) = 0) ;; SELECT device_name, day, place, frame_id, us FROM s WHERE place < {SAMPLES}"""))
def day_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty frames of each device and day, evenly spread (all, where there are no more)."""
    whole = Window.partitionBy("device_name", "day")
    rows = domain.frames(spark, sf).where("us IS NOT NULL").select("device_name", F.floor(F.col("us") / DAY_US).alias("day"), "frame_id", "us")
    rows = rows.withColumn("no", F.row_number().over(whole.orderBy("us", "frame_id")) - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / SAMPLES)))
    return rows.where(F.col("no") % F.col("step") == 0).select("device_name", "day", F.floor(F.col("no") / F.col("step")).alias("place"), "frame_id", "us").where(F.col("place") < SAMPLES)


@_query(sql("fr", f"""r AS (SELECT f.*, d.time_zone, row_number() OVER (PARTITION BY f.device_name ORDER BY us DESC, frame_id) AS no FROM fr f LEFT JOIN (SELECT device_name, min(time_zone) AS time_zone FROM devices GROUP BY 1) d ON d.device_name = f.device_name WHERE us IS NOT NULL AND f.device_name IS NOT NULL AND image_path <> '')
    ;; SELECT device_name, string_agg(strftime(timezone(coalesce(time_zone, 'UTC'), make_timestamptz(us)), '%Y-%m-%d %H:%M:%S') || ' ' || image_path, chr(10) ORDER BY us, frame_id) || chr(10) || 'What happened here?' AS context FROM r WHERE no <= 5 GROUP BY 1"""))
def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each device's five latest pictures, a line of local time and path each, oldest first, and the question."""
    zones = table(spark, sf, "devices").groupBy("device_name").agg(F.min("time_zone").alias("time_zone"))
    order = Window.partitionBy("device_name").orderBy(F.desc("us"), "frame_id")
    rows = domain.frames(spark, sf).where("us IS NOT NULL AND device_name IS NOT NULL AND image_path <> ''").withColumn("no", F.row_number().over(order)).where("no <= 5").join(zones, "device_name", "left")
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), F.coalesce("time_zone", F.lit("UTC"))), "yyyy-MM-dd HH:mm:ss")
    lines = F.array_sort(F.collect_list(F.struct("us", "frame_id", F.concat(local, F.lit(" "), "image_path").alias("line"))))
    return rows.groupBy("device_name").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\nWhat happened here?")).alias("context"))


@_query(sql("fr", "n AS (SELECT video_chunk_id AS id, count(*) AS n FROM fr WHERE video_chunk_id > 0 GROUP BY 1), v AS (SELECT id, max(frame_count) AS claimed FROM video_chunks GROUP BY 1) ;; SELECT v.id, claimed, coalesce(n, 0) AS frame_count FROM v LEFT JOIN n USING (id)"))
def chunk_frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Video chunks with the number of frames that really point to them, beside the number stored."""
    counted = domain.frames(spark, sf).where("video_chunk_id > 0").groupBy(F.col("video_chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("frame_count"))
    chunks = table(spark, sf, "video_chunks").groupBy("id").agg(F.max("frame_count").alias("claimed"))
    return chunks.join(counted, "id", "left").select("id", "claimed", F.coalesce("frame_count", F.lit(0)).alias("frame_count"))


def strategy(text: Column, has_picture: Column) -> Column:
    """How to search: a picture by its vector, exact words by text, anything else by both."""
    exact = F.lit(False)
    for w in EXACT_WORDS:
        exact = exact | F.lower(text).contains(w)
    return F.when(has_picture, "semantic").when(exact, "text").when(text != "", "hybrid")


@_query(sql("su", f"q AS (SELECT window_name AS w, min(app) = '' OR min(app) IS NULL AS bare FROM su GROUP BY 1) ;; SELECT w AS query, CASE WHEN bare THEN 'semantic' WHEN {' OR '.join(f'contains(lower(w), {w!r})' for w in EXACT_WORDS)} THEN 'text' WHEN w <> '' THEN 'hybrid' END AS strategy FROM q"))
def search_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The way to search for each window title; titles without an app are looked for by picture."""
    titles = domain.sub_frames(spark, sf).groupBy(F.col("window_name").alias("query")).agg(F.coalesce(F.min("app") == "", F.lit(True)).alias("bare"))
    return titles.select("query", strategy(F.col("query"), F.col("bare")).alias("strategy"))


@_query(sql("ve cl asg", "ce AS (SELECT id, max(list_transform(centroid, lambda x: x::DOUBLE)) AS c FROM cl WHERE len(centroid) = 64 GROUP BY 1) ;; SELECT v.key, a.cluster_id, round((1 + coalesce(list_sum(list_transform(list_zip(v.vector, ce.c), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(ce.c, lambda x: x * x))), 0), 0)) / 2, 6) AS similarity FROM ve v JOIN asg a ON a.sub_frame_id = v.key JOIN ce ON ce.id = a.cluster_id"))
def similarity_to_own(spark: SparkSession, sf: str) -> DataFrame:
    """How near each capture is to the centroid of its cluster, from 0 to 1; a zero centroid gives a half."""
    centres = domain.clusters(spark, sf).where(F.size("centroid") == 64).groupBy(F.col("id").alias("cluster_id")).agg(F.max(F.transform("centroid", lambda x: x.cast("double"))).alias("c"))
    own = domain.assignments(spark, sf).where("cluster_id IS NOT NULL").select(F.col("sub_frame_id").alias("key"), "cluster_id").join(centres, "cluster_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(total(F.transform("c", lambda x: x * x)))
    cosine = F.coalesce(total(F.zip_with("vector", "c", lambda a, b: a * b)) / F.when(norm > 0, norm), F.lit(0.0))
    return domain.vectors(spark, sf).join(own, "key").select("key", "cluster_id", F.round((1 + cosine) / 2, 6).alias("similarity"))
