"""Search, clusters of vectors, labels and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolens.functions.text import any_of, estimated_tokens, plain_label, same_activity
from chronolens.operators.leaders import bursts, changed_rows, leader_clusters, report_chunks
from chronolens.operators.many import best_of_app
from chronolens.operators.search import app_filter, bm25, fuse_ranks, fuse_scores, merge_first, merge_ranges, nearest_rows
from chronolens.plans.analytics import _SESSION, DAY_US, _sessions
from chronolens.plans.prelude import sql
from chronolens.sources import domain
from chronolens.sources.tables import table
from chronolens.streaming.sources import drain, ordered_stream

QUERY_WORDS, K = ["harbour", "report", "keyboard", "balance"], 20
RELATED, WINDOW_APP = ["tern mail", "slate notes"], "tern mail"

QUERIES: dict = {}
ORACLE: dict = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return domain.texts(spark, sf).where("sub_frame_id IS NOT NULL").select("id", "sub_frame_id", "text")


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_BM25 = f"""w AS (SELECT id, sub_frame_id, {_WORDS} AS w FROM tx WHERE sub_frame_id IS NOT NULL AND text IS NOT NULL), d AS (SELECT id, sub_frame_id, len(w) AS length, w FROM w WHERE len(w) > 0),
    sz AS (SELECT count(*) AS texts, avg(length) AS mean FROM d), tf AS (SELECT id, word, count(*) AS tf, any_value(length) AS length FROM (SELECT id, length, unnest(w) AS word FROM d) WHERE word IN ({", ".join(repr(w) for w in QUERY_WORDS)}) GROUP BY 1, 2),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS n FROM tf JOIN df USING (word) CROSS JOIN sz GROUP BY id)"""


@_query(sql("tx", f"{_BM25} ;; SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {K}"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25(_texts(spark, sf), QUERY_WORDS).orderBy(F.desc("score"), "id").limit(K)


@_query(sql("tx", r"h AS (SELECT id, length(text) AS n FROM tx WHERE text ILIKE '%quarterly%report%') ;; SELECT id, n FROM h"))
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return domain.texts(spark, sf).where(F.col("text").ilike("%quarterly%report%")).select("id", "n")


@_query(sql("tx", f"{_BM25} ;; SELECT id, score FROM bm WHERE n = 2".replace("harbour", "quarterly").replace(", 'keyboard', 'balance'", "")))
def bm25_all_words(spark: SparkSession, sf: str) -> DataFrame:
    return bm25(_texts(spark, sf), ["quarterly", "report"], need_all=True)


def _probe(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: the smallest key's (one row)."""
    return list(domain.vectors(spark, sf).orderBy("key").select("vector").first()[0])


_DENSE = "q AS (SELECT vector AS qv FROM ve ORDER BY key LIMIT 1), de AS (SELECT key, app, round(list_sum(list_transform(list_zip(vector, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM ve, q {where})"


@_query(sql("ve", _DENSE.format(where="") + f" ;; SELECT key, app, distance FROM de ORDER BY distance, key LIMIT {K}"))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rows(domain.vectors(spark, sf), _probe(spark, sf), K)


@_query(sql("ve", _DENSE.format(where="WHERE app IN ('tern mail', 'slate notes')") + f" ;; SELECT key, app, distance FROM de ORDER BY distance, key LIMIT {K}"))
def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rows(domain.vectors(spark, sf), _probe(spark, sf), K, app_filter(F.col("app"), related=RELATED, unrelated=["ledger grid"]))


@_query(sql("ve su", _DENSE.format(where=f"WHERE (app = '{WINDOW_APP}' AND key IN (SELECT sub_frame_id FROM su WHERE window_name IN ('Untitled', 'Untitled - Tern Mail'))) OR app = 'quill writer'") + f" ;; SELECT key, app, distance FROM de ORDER BY distance, key LIMIT {K}"))
def dense_windows(spark: SparkSession, sf: str) -> DataFrame:
    windows = domain.sub_frames(spark, sf).select(F.col("sub_frame_id").alias("key"), "window_name")
    rows = domain.vectors(spark, sf).join(windows, "key", "left")
    only = app_filter(F.col("app"), related=["cairn files"], include={WINDOW_APP: ["Untitled", "Untitled - Tern Mail"], "quill writer": []}, window=F.col("window_name"))
    return nearest_rows(rows, _probe(spark, sf), K, only)


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    dense = nearest_rows(domain.vectors(spark, sf), _probe(spark, sf), 50).select("key", "distance")
    best = bm25(_texts(spark, sf), QUERY_WORDS).join(_texts(spark, sf).select("id", "sub_frame_id"), "id")
    sparse = best.groupBy(F.col("sub_frame_id").alias("key")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "key").limit(50)
    return dense, sparse


_TWO = _DENSE.format(where="") + ", " + _BM25 + ", dl AS (SELECT key, distance, row_number() OVER (ORDER BY distance, key) AS place FROM (SELECT * FROM de ORDER BY distance, key LIMIT 50)), sl AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS place FROM (SELECT sub_frame_id AS key, max(score) AS score FROM bm JOIN d USING (id) GROUP BY 1 ORDER BY score DESC, key LIMIT 50))"


@_query(sql("ve tx", f"{_TWO} ;; SELECT key, round(sum(1.0 / (60 + place)), 9) AS score FROM (SELECT key, place FROM dl UNION ALL SELECT key, place FROM sl) GROUP BY key ORDER BY score DESC, key LIMIT {K}"))
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_ranks(*_lists(spark, sf), K)


@_query(sql("ve tx", f"{_TWO}, da AS (SELECT key, (max(distance) OVER () - distance) / (max(distance) OVER () - min(distance) OVER ()) AS a FROM dl), sb AS (SELECT key, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS b FROM sl) ;; SELECT coalesce(da.key, sb.key) AS key, round(0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0), 6) AS score FROM da FULL JOIN sb ON da.key = sb.key ORDER BY score DESC, key LIMIT {K}"))
def hybrid_linear(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_scores(*_lists(spark, sf), K)


@_query(sql("ve tx", f"{_TWO}, f AS (SELECT key, min((list_no, place)) AS f FROM (SELECT key, 0 AS list_no, place FROM dl UNION ALL SELECT key, 1, place FROM sl) GROUP BY key) ;; SELECT row_number() OVER (ORDER BY f) AS place, key, f.list_no AS list_no FROM f").replace("min((list_no, place)) AS f", "min({'list_no': list_no, 'place': place}) AS f"))
def rag_merge(spark: SparkSession, sf: str) -> DataFrame:
    dense, sparse = _lists(spark, sf)
    at = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
    return merge_first([at(dense, F.col("distance"), F.col("key")), at(sparse, F.desc("score"), F.col("key"))])


@_query(sql("cl", "c AS (SELECT *, epoch_us(committed_at) AS a FROM (SELECT id, committed_at, created_at, last_frame_timestamp, updated_at FROM activity_clusters)), r AS (SELECT id, epoch_us(created_at) AS s1, epoch_us(last_frame_timestamp) AS e1, epoch_us(committed_at) AS s2, epoch_us(updated_at) AS e2 FROM c), m AS (SELECT *, greatest(s1, s2) AS lo, least(e1, e2) AS hi FROM r) ;; SELECT id, CASE WHEN lo > hi AND (s1 IS NOT NULL OR e1 IS NOT NULL) THEN s1 ELSE lo END AS start_us, CASE WHEN lo > hi AND (s1 IS NOT NULL OR e1 IS NOT NULL) THEN e1 ELSE hi END AS end_us FROM m"))
def ranges_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The common part of each cluster's two time ranges (seen, committed)."""
    us = F.unix_micros
    start, end = merge_ranges(us("created_at"), us("last_frame_timestamp"), us("committed_at"), us("updated_at"))
    return table(spark, sf, "activity_clusters").select("id", start.alias("start_us"), end.alias("end_us"))


@_query(sql("ve asg", "x AS (SELECT a.cluster_id, v.key, unnest(v.vector) AS x, unnest(range(64)) AS i FROM ve v JOIN asg a ON a.sub_frame_id = v.key WHERE a.cluster_id IS NOT NULL), c AS (SELECT cluster_id, i, round(avg(x), 6) AS x, count(*) AS n FROM x GROUP BY 1, 2) ;; SELECT cluster_id, max(n) AS n, round(sum(x * (i + 1)), 3) AS weighted, round(sqrt(sum(x * x)), 4) AS norm FROM c GROUP BY 1"))
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of each cluster's captures, as its norm and an index-weighted sum."""
    rows = domain.vectors(spark, sf).join(domain.assignments(spark, sf).where("cluster_id IS NOT NULL").select(F.col("sub_frame_id").alias("key"), "cluster_id"), "key")
    mean = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.round(F.avg(F.get("vector", F.lit(i))), 6) for i in range(64)]).alias("c"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return mean.select("cluster_id", "n", F.round(total(F.transform("c", lambda x, i: x * (i + 1))), 3).alias("weighted"), F.round(F.sqrt(total(F.transform("c", lambda x: x * x))), 4).alias("norm"))


@_query(sql("asg", "SELECT cluster_id, place, sub_frame_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY us DESC NULLS LAST, sub_frame_id) AS place FROM asg WHERE cluster_id IS NOT NULL) WHERE place <= 3"))
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("us"), "sub_frame_id")
    return domain.assignments(spark, sf).where("cluster_id IS NOT NULL").withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").select("cluster_id", "place", "sub_frame_id")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_CENTRES = "ce AS (SELECT id, app, list_transform(centroid, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(centroid, lambda y: y::DOUBLE * y)))) AS c FROM cl WHERE len(centroid) = 64 AND list_sum(list_transform(centroid, lambda x: abs(x))) > 0)"


@_query(sql("ve cl", f"{_CENTRES}, s AS (SELECT v.key, e.id, round({_COS.format(a='v.vector', b='e.c')}, 6) AS similarity FROM ve v JOIN ce e ON e.app = v.app) ;; SELECT key, id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY similarity DESC, id) = 1"))
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Each capture's most similar cluster of its own app."""
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    good = (F.size("centroid") == 64) & F.exists("centroid", lambda x: x != 0)
    centres = domain.clusters(spark, sf).where(good).select("id", "app", F.transform("centroid", lambda x: x.cast("double") / norm).alias("vector"))
    return best_of_app(domain.vectors(spark, sf), centres)


@_query()
def leaders(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clusters of each device's app over all its days."""
    when = domain.sub_frames(spark, sf).where("us IS NOT NULL").select(F.col("sub_frame_id").alias("key"), "device_name", "us", F.floor(F.col("us") / DAY_US).alias("day"))
    rows = domain.vectors(spark, sf).join(when, "key").select("device_name", "app", "day", "us", "key", "vector")
    return drain(leader_clusters(ordered_stream(rows, ["us", "key"], "leaders"), keys=("device_name", "app")), "leaders")


_LABELS = "l AS (SELECT app, label, count(*) AS n FROM asg WHERE label <> '' GROUP BY 1, 2)"


@_query()
def label_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Provisional labels and the known labels of their app that mean the same, best first known wins."""
    rows = domain.assignments(spark, sf)
    new = rows.where("provisional <> ''").select("app", F.col("provisional").alias("new")).distinct()
    known = rows.where("label <> ''").groupBy("app", "label").agg(F.coalesce(F.min("us"), F.lit(2**62)).alias("since"))
    pairs = new.join(known, "app").where(same_activity(F.col("new"), F.col("label")))
    return pairs.groupBy("app", "new").agg(F.min(F.struct("since", "label")).alias("f")).select("app", "new", F.col("f.label").alias("known"))


ORACLE["label_matches"] = sql(
    "asg",
    r"""n AS (SELECT DISTINCT app, provisional AS new FROM asg WHERE provisional <> ''), k AS (SELECT app, label, coalesce(min(us), 4611686018427387904) AS since FROM asg WHERE label <> '' GROUP BY 1, 2),
    p AS (SELECT n.app, n.new, k.label, k.since, regexp_replace(n.new, '\s', '', 'g') AS x, regexp_replace(k.label, '\s', '', 'g') AS y FROM n JOIN k ON k.app = n.app) ;;
    SELECT app, new, arg_min(label, (since, label)) AS known FROM p WHERE regexp_replace(new, '[^\p{L}\p{N}]', '', 'g') = regexp_replace(label, '[^\p{L}\p{N}]', '', 'g') OR (length(new) >= 3 AND length(label) >= 3 AND (contains(new, label) OR contains(label, new)))
        OR len(list_intersect(string_split(x, ''), string_split(y, ''))) > 0.6 * len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) GROUP BY 1, 2""",
)


@_query(sql("cl", "SELECT app, regexp_replace(label, '[^\\p{L}\\p{N}]', '', 'g') AS plain, min(id) AS id, count(*) AS merged, coalesce(sum(frame_count), 0)::BIGINT AS frames FROM cl WHERE label <> '' GROUP BY 1, 2"))
def clusters_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of an app whose labels are written differently, as one: counts added, smallest id kept."""
    return domain.clusters(spark, sf).where("label <> ''").groupBy("app", plain_label(F.col("label")).alias("plain")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("merged"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"))


@_query(sql("asg", "SELECT sub_frame_id, cluster_id, status, CASE WHEN status = 'committed' AND updated_us < (SELECT max(updated_us) FROM asg) - 1800000000 THEN updated_us END AS frozen_us FROM asg"))
def assignments_frozen(spark: SparkSession, sf: str) -> DataFrame:
    """Committed assignments older than half an hour before the newest are final."""
    rows = domain.assignments(spark, sf)
    newest = F.broadcast(rows.agg(F.max("updated_us").alias("newest")))  # one row
    due = (F.col("status") == "committed") & (F.col("updated_us") < F.col("newest") - 1_800_000_000)
    return rows.join(newest, F.lit(True)).select("sub_frame_id", "cluster_id", "status", F.when(due, F.col("updated_us")).alias("frozen_us"))


@_query(sql("fr", "SELECT frame_id, device_name, us, app FROM (SELECT *, lag(app) OVER w AS before, row_number() OVER w AS no FROM fr WHERE us IS NOT NULL WINDOW w AS (PARTITION BY device_name, us // 86400000000 ORDER BY us, frame_id)) WHERE no = 1 OR app IS DISTINCT FROM before"))
def changed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose app differs from that of the frame before, and each day's first."""
    order = Window.partitionBy("device_name", F.floor(F.col("us") / DAY_US)).orderBy("us", "frame_id")
    rows = domain.frames(spark, sf).where("us IS NOT NULL").withColumn("before", F.lag("app").over(order)).withColumn("no", F.row_number().over(order))
    return rows.where((F.col("no") == 1) | ~F.col("app").eqNullSafe(F.col("before"))).select("frame_id", "device_name", "us", "app")


@_query("""WITH RECURSIVE e AS (SELECT event_type, ts::DATE AS day, ts, event_id, value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS no FROM events WHERE value IS NOT NULL),
    r AS (SELECT event_type, day, ts, event_id, value, no, value AS held, true AS keep FROM e WHERE no = 1
        UNION ALL SELECT e.event_type, e.day, e.ts, e.event_id, e.value, e.no, CASE WHEN abs(e.value - r.held) > 5 THEN e.value ELSE r.held END, abs(e.value - r.held) > 5 FROM r JOIN e ON e.event_type = r.event_type AND e.day = r.day AND e.no = r.no + 1)
    SELECT event_type, strftime(day, '%Y-%m-%d') AS day, epoch_us(ts) AS at, event_id, value FROM r WHERE keep""")
def changed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value differs by more than 5 from the last one kept, for each type and day."""
    rows = table(spark, sf, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    return changed_rows(rows, ["event_type", "day"], ["at", "event_id"], "value", 5.0)


@_query(sql("su", """u AS (SELECT device_name, us // 86400000000 AS day, us, row_number() OVER (PARTITION BY device_name, us // 86400000000 ORDER BY us) AS no FROM su WHERE us IS NOT NULL),
    r AS (SELECT *, us AS anchor FROM u WHERE no = 1 UNION ALL SELECT u.*, CASE WHEN u.us - r.anchor >= 1000000 THEN u.us ELSE r.anchor END FROM r JOIN u ON u.device_name IS NOT DISTINCT FROM r.device_name AND u.day = r.day AND u.no = r.no + 1) ;;
    SELECT device_name, day, anchor AS start_us, max(us) AS end_us, count(*) AS n FROM r GROUP BY 1, 2, 3""").replace("WITH", "WITH RECURSIVE", 1))
def burst_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Windows captured within a second of a group's first, for each device and day."""
    rows = domain.sub_frames(spark, sf).where("us IS NOT NULL").select("device_name", F.floor(F.col("us") / DAY_US).alias("day"), "us")
    return bursts(rows, ["device_name", "day"], 1_000_000)


@_query(sql("asg cl su", f"""{_SESSION}, rs AS (SELECT s.device_name, s.app, start_us // 86400000000 AS day, start_us, end_us, CASE WHEN length(concat_ws('/', s.app, c.label)) = 0 THEN 0 ELSE greatest(1, length(concat_ws('/', s.app, c.label)) // 3) END + 20 AS tokens FROM se s LEFT JOIN cl c ON c.id = s.cluster_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY device_name, app, day ORDER BY start_us, end_us, tokens) AS no FROM rs),
    r AS (SELECT *, 0::BIGINT AS chunk_no, tokens AS used FROM o WHERE no = 1
        UNION ALL SELECT o.*, r.chunk_no + (r.used + o.tokens > 400 OR o.start_us - r.end_us > 600000000)::BIGINT, CASE WHEN r.used + o.tokens > 400 OR o.start_us - r.end_us > 600000000 THEN 0 ELSE r.used END + o.tokens
            FROM r JOIN o ON o.device_name IS NOT DISTINCT FROM r.device_name AND o.app IS NOT DISTINCT FROM r.app AND o.day = r.day AND o.no = r.no + 1) ;;
    SELECT device_name, app, day, chunk_no, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS sessions, sum(tokens)::BIGINT AS tokens FROM r GROUP BY 1, 2, 3, 4""").replace("WITH", "WITH RECURSIVE", 1))
def report_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's sessions of a device's app in chunks of at most 400 estimated tokens and gaps of 10 minutes."""
    names = domain.clusters(spark, sf).select(F.col("id").alias("cluster_id"), "label")
    rows = _sessions(spark, sf).join(names, "cluster_id", "left").select("device_name", "app", F.floor(F.col("start_us") / DAY_US).alias("day"), "start_us", "end_us", (estimated_tokens(F.concat_ws("/", "app", "label")) + 20).alias("tokens"))
    return report_chunks(rows, ["device_name", "app", "day"], 400, 600_000_000)


@_query(sql("tx su", "d AS (SELECT s.app, s.us // 86400000000 AS day, left(trim(t.text), 200) AS snippet, min((t.confidence * -1, t.id)) AS k FROM tx t JOIN su s USING (sub_frame_id) WHERE trim(t.text) <> '' AND t.confidence IS NOT NULL AND s.us IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY app, day ORDER BY k ROWS UNBOUNDED PRECEDING) AS used FROM d) ;; SELECT app, day, count(*) AS snippets, sum(length(snippet))::BIGINT AS characters FROM r WHERE used <= 4000 GROUP BY 1, 2"))
def report_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct 200-character snippets of an app's day, surest first, until 4 000 characters are used up."""
    subs = domain.sub_frames(spark, sf).where("us IS NOT NULL").select("sub_frame_id", "app", F.floor(F.col("us") / DAY_US).alias("day"))
    rows = domain.texts(spark, sf).where("trim(text) <> '' AND confidence IS NOT NULL").join(subs, "sub_frame_id")
    once = rows.groupBy("app", "day", F.substring(F.trim("text"), 1, 200).alias("snippet")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id")).alias("k"))
    used = F.sum(F.length("snippet")).over(Window.partitionBy("app", "day").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("used", used).where("used <= 4000").groupBy("app", "day").agg(F.count(F.lit(1)).alias("snippets"), F.sum(F.length("snippet").cast("long")).alias("characters"))


@_query(sql("", "SELECT (doc_id) AS doc_id, CASE WHEN length(text) = 0 OR text IS NULL THEN 0 ELSE greatest(1, length(text) // 3) END AS tokens FROM documents"))
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


@_query(sql("su", "SELECT app, count(*) AS n, count(*) FILTER (lower(window_name) IN ('untitled', 'loading', 'settings')) AS system_windows FROM su WHERE NOT (app LIKE '%console%' OR app LIKE '%terminal%') GROUP BY 1"))
def visible_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Captures by app without those of skipped apps; titles on a skip list are counted apart."""
    skipped = any_of([F.col("app").contains(w) for w in ("console", "terminal")])
    title = F.lower("window_name").isin("untitled", "loading", "settings")
    return domain.sub_frames(spark, sf).where(~skipped).groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(title, 1)).alias("system_windows"))
