"""Ranked retrieval: BM25 over postings, exact vector search with filters, fusion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF = 60


def postings(texts: DataFrame) -> DataFrame:
    """(id, word, tf, length): how often each text has each lower-case word of letters and digits."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = texts.where("text IS NOT NULL").select("id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("id", F.size("w").cast("long").alias("length"), F.explode("w").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(texts: DataFrame, query: list[str], need_all: bool = False) -> DataFrame:
    """(id, score) of texts with any (or all) of the ``query`` words.

    Word counts cover every text; only postings of query words are shuffled. Empty
    texts have no rank; an unknown word adds nothing.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = texts.where("text IS NOT NULL").select("id", words.alias("w")).where(F.size("w") > 0)
    size = rows.agg(F.count(F.lit(1)).alias("texts"), F.avg(F.size("w")).alias("mean"))
    hits = rows.select("id", F.size("w").alias("length"), F.explode(F.filter("w", lambda w: w.isin(query))).alias("word"))
    tf = hits.groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(F.broadcast(df), "word").join(F.broadcast(size), F.lit(True))  # one row a query word, one row
    idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("__words"))
    return (out.where(F.col("__words") == len(set(query))) if need_all else out).select("id", "score")


def distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to a literal vector, in double precision."""
    parts = F.zip_with(vector, F.lit(query), lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest_rows(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` among those that pass ``where``: filter first, then search."""
    rows = vectors if where is None else vectors.where(where)
    return rows.select("key", "app", F.round(distance(F.col("vector"), query), 6).alias("distance")).orderBy("distance", "key").limit(k)


def app_filter(app: Column, related: list[str] | None = None, unrelated: list[str] | None = None, include: dict[str, list[str]] | None = None, exclude: dict[str, list[str]] | None = None, window: Column | None = None) -> Column:
    """Which rows a search may return.

    Window includes outweigh everything else; then related apps, then unrelated
    ones; window excludes count only without includes. No window names for an app
    means all of its windows.
    """
    def of(windows: dict[str, list[str]]) -> Column:
        return reduce(lambda a, b: a | b, [(app == a) & window.isin(w) if w else app == a for a, w in windows.items()])

    if include:
        return F.coalesce(of(include), F.lit(False))
    keep = F.lit(True)
    if related:
        keep = app.isin(related)
    elif unrelated:
        keep = ~F.coalesce(app.isin(unrelated), F.lit(False))
    return F.coalesce(keep & ~F.coalesce(of(exclude), F.lit(False)), F.lit(False)) if exclude else F.coalesce(keep, F.lit(False))


def _placed(ranked: DataFrame, by: list[Column]) -> DataFrame:
    """Place of each row of a top-k list (a bounded list, so one window)."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))


def fuse_ranks(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """(key, score) by reciprocal ranks of two top-k lists (key, distance) and (key, score)."""
    lists = _placed(dense, [F.col("distance"), F.col("key")]).select("key", "place").unionByName(_placed(sparse, [F.desc("score"), F.col("key")]).select("key", "place"))
    return lists.groupBy("key").agg(F.round(F.sum(1 / (RRF + F.col("place"))), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def fuse_scores(dense: DataFrame, sparse: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(key, score): both lists scaled to 0..1 among their own rows, a missing side counts 0."""
    every = Window.partitionBy(F.lit(0))
    scaled = lambda df, c, name: df.select("key", F.coalesce((F.col(c) - F.min(c).over(every)) / F.when(F.max(c).over(every) > F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)), F.lit(1.0)).alias(name))
    both = scaled(dense.withColumn("near", -F.col("distance")), "near", "a").join(scaled(sparse, "score", "b"), "key", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("key", F.round(weight * zero("a") + (1 - weight) * zero("b"), 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def merge_first(lists: list[DataFrame]) -> DataFrame:
    """(place, key, list_no) of several ranked lists (key, place) one after the other; a key's first place counts."""
    every = None
    for no, one in enumerate(lists):
        part = one.select("key", F.lit(no).alias("list_no"), "place")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("key").agg(F.min(F.struct("list_no", "place")).alias("f")).select("key", "f.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("list_no", "place")).cast("long")).select("place", "key", "list_no")


def merge_ranges(start: Column, end: Column, other_start: Column, other_end: Column) -> tuple[Column, Column]:
    """The common part of a stated and an inferred time range; the stated one if they have none.

    Missing bounds are open; an inferred range alone is taken as it is.
    """
    low, high = F.greatest(start, other_start), F.least(end, other_end)
    empty = (low > high) & (start.isNotNull() | end.isNotNull())
    return F.when(empty, start).otherwise(low), F.when(empty, end).otherwise(high)


def search_by(mode: str, lists: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """The list of ``mode``, made only when it is asked for; an unknown mode finds nothing."""
    return lists[mode]() if mode in lists else spark.createDataFrame([], "key string")
