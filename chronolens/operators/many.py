"""Ranked retrieval for many queries at once: every query against every row, the best k of each.

Queries go out in passes of a bounded number, so a broadcast stays small however
many there are; a task matches a pass in blocks against the rows it reads and
holds the best rows of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolens.operators.search import K1, RRF, B
from chronolens.sources.shipping import ship
from chronolens.sources.staging import stage

#: Queries a pass, and queries matched at once inside a task.
A_PASS, BLOCK = 16_384, 512
#: float32 distances may be off by so much; what lies closer is settled in double.
_SLACK = 1e-5


class Best:
    """The k smallest (value, key) of each query of a block, one row for each key."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.inf)  # least: the value that a further row must not exceed
        self.q, self.value, self.key, self.other = np.zeros(0, np.int64), np.zeros(0), None, None

    def add(self, q: np.ndarray, value: np.ndarray, key: np.ndarray, other: np.ndarray) -> None:
        if self.key is not None:
            q, value, key, other = (np.concatenate(x) for x in ((self.q, q), (self.value, value), (self.key, key), (self.other, other)))
        order = np.lexsort((value, key, q))
        q, value, key, other = q[order], value[order], key[order], other[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (key[1:] != key[:-1])
        q, value, key, other = q[fresh], value[fresh], key[fresh], other[fresh]
        order = np.lexsort((key, value, q))
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]  # q is sorted, before and after
        self.q, self.value, self.key, self.other = q[order], value[order], key[order], other[order]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.least)) == self.k)
        self.least[full] = self.value[np.searchsorted(self.q, full, side="right") - 1]


def _bound(values: np.ndarray, best: Best, keys: np.ndarray) -> np.ndarray:
    """What each query's further rows must not exceed: from the rows held, else from this batch."""
    least = best.least.copy()
    open_ = np.flatnonzero(np.isinf(least))
    at = best.k * int(np.unique(keys, return_counts=True)[1].max())  # so many rows hold k keys for sure
    if len(open_) and at < values.shape[1]:
        least[open_] = np.partition(values[open_], at - 1, axis=1)[:, at - 1]
    return least


def _rows(names: list[str], ids: np.ndarray, found: list[tuple[int, Best]], key: pa.DataType) -> pa.RecordBatch:
    held = [(s, b) for s, b in found if b.key is not None]
    joined = lambda parts, kind: pa.array(np.concatenate(parts).tolist() if held else [], kind)
    return pa.RecordBatch.from_arrays([joined([ids[s + b.q] for s, b in held], pa.int64()), joined([b.key for _, b in held], key), joined([b.other for _, b in held], pa.string()), joined([b.value for _, b in held], pa.float64())], names=names)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query from the tasks' lists."""
    hits = F.slice(F.array_sort(F.collect_set(F.struct("value", "key", "other"))), 1, k)
    return found.groupBy("query").agg(hits.alias("h")).select("query", F.posexplode("h").alias("at", "h")).select("query", (F.col("at") + 1).cast("long").alias("place"), "h.key", "h.other", "h.value")


def _passes(queries: DataFrame) -> Iterator[pa.Table]:
    n = -(-queries.count() // A_PASS)
    for p in range(n):
        yield queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == p).toArrow()


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(n, -1)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query, place, key, app, distance): the ``k`` of ``vectors`` (key, app, vector) nearest to each of ``queries`` (query, vector).

    Vectors have unit length; distances are squared Euclidean ones, rounded to 6
    decimals. Filter first, then search; ties go to the smaller key.
    """
    rows = (vectors if where is None else vectors.where(where)).select("key", "app", "vector")
    sc, every, asked = ship(vectors.sparkSession), None, stage(queries.select("query", "vector"), "queries")
    for table in _passes(asked):
        shared = sc.broadcast((table.column("query").to_numpy(), _matrix(table.column("vector"), table.num_rows)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wide = shared.value
            found = [(s, Best(len(ids[s : s + BLOCK]), k)) for s in range(0, len(ids), BLOCK)]
            thin = wide.astype(np.float32)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, apps = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), object)
                own = _matrix(batch.column(2), batch.num_rows)
                small = own.astype(np.float32).T
                for s, best in found:
                    far = 2 - 2 * (thin[s : s + BLOCK] @ small)
                    q, c = np.nonzero(far <= (_bound(far, best, keys) + _SLACK)[:, None].astype(np.float32))
                    exact = np.round(np.maximum(((wide[s + q] - own[c]) ** 2).sum(1), 0), 6)
                    keep = exact <= best.least[q]
                    if keep.any():
                        best.add(q[keep], exact[keep], keys[c[keep]], apps[c[keep]])
            yield _rows(["query", "key", "other", "value"], ids, found, pa.string())

        part = rows.mapInArrow(search, "query long, key string, other string, value double")
        every = part if every is None else every.unionByName(part)
    if every is None:
        every = vectors.sparkSession.createDataFrame([], "query long, key string, other string, value double")
    return _top(every, k).select("query", "place", "key", F.col("other").alias("app"), F.col("value").alias("distance"))


def text_words(texts: DataFrame) -> DataFrame:
    """(key, id, h): hashes of all words of each text of (key, id, text) that has any."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return texts.where("text IS NOT NULL").select("key", "id", F.transform(words, lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)


def bm25_each(words: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, place, key, score): the ``k`` best keys of ``words`` (key, h) for each of ``queries`` (query, h).

    A key with several texts has the best one's score. Counts cover every text;
    a query asks for all of its distinct words.
    """
    spark, kind = words.sparkSession, words.schema["key"].dataType.simpleString()
    sc, every, asked = ship(spark), None, stage(queries.select("query", F.array_distinct("h").alias("h")), "queries")
    schema = f"query long, key {kind}, other string, value double"
    texts, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("h"))).first()
    counts = words.select(F.explode(F.array_distinct("h")).alias("h")).join(asked.select(F.explode("h").alias("h")).distinct(), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    counts = stage(counts, "word-counts")
    for table in _passes(asked):
        lists = table.column("h").combine_chunks()
        vocabulary, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        of = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        known = counts.join(spark.createDataFrame(pa.table({"h": vocabulary})), "h").toArrow()
        idf = np.zeros(len(vocabulary))
        df = known.column("df").to_numpy()
        idf[np.searchsorted(vocabulary, known.column("h").to_numpy())] = np.log(1 + (texts - df + 0.5) / (df + 0.5))
        shared = sc.broadcast((table.column("query").to_numpy(), vocabulary, idf, of, word, float(mean)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vocabulary, idf, of, word, mean = shared.value
            found = [(s, Best(len(ids[s : s + BLOCK]), k)) for s in range(0, len(ids), BLOCK)]
            asks = []
            for s, _ in found:
                own = slice(*np.searchsorted(of, [s, s + BLOCK]))
                order = np.argsort(word[own], kind="stable")
                terms, first = np.unique(word[own][order], return_index=True)
                asks.append((terms, np.split(of[own][order] - s, first[1:])))
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, lengths = np.array(batch.column(0).to_pylist()), np.diff(batch.column(1).offsets.to_numpy())
                flat, doc = batch.column(1).flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lengths)
                at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                same = vocabulary[at] == flat
                pair, tf = np.unique(at[same] * batch.num_rows + doc[same], return_counts=True)
                term, doc = np.divmod(pair, batch.num_rows)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
                for (s, best), (terms, askers) in zip(found, asks):
                    score = np.zeros((len(best.least), batch.num_rows))
                    begin, end = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
                    for i in np.flatnonzero(end > begin):
                        docs, w = doc[begin[i] : end[i]], weight[begin[i] : end[i]]
                        if 8 * len(docs) > batch.num_rows:
                            full = np.zeros(batch.num_rows)
                            full[docs] = w
                            for a in askers[i]:
                                score[a] += full
                        else:
                            for a in askers[i]:
                                score[a, docs] += w
                    far = -score
                    q, c = np.nonzero((far <= (_bound(far, best, keys) + 1e-6)[:, None]) & (far < 0))
                    exact = np.round(far[q, c], 6)
                    keep = exact <= best.least[q]
                    if keep.any():
                        best.add(q[keep], exact[keep], keys[c[keep]], np.full(int(keep.sum()), None, object))
            yield _rows(["query", "key", "other", "value"], ids, found, pa.int64() if kind == "bigint" else pa.string())

        part = words.select("key", "h").mapInArrow(search, schema)
        every = part if every is None else every.unionByName(part)
    if every is None:
        every = spark.createDataFrame([], schema)
    return _top(every, k).select("query", "place", "key", (-F.col("value")).alias("score"))


def _first(ranked: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return ranked.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("query", "place", "key", "score")


def fuse_ranks_each(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """(query, place, key, score) by reciprocal ranks of each query's two lists (query, place, key)."""
    lists = dense.select("query", "key", "place").unionByName(sparse.select("query", "key", "place"))
    return _first(lists.groupBy("query", "key").agg(F.round(F.sum(1 / (RRF + F.col("place"))), 9).alias("score")), k)


def fuse_scores_each(dense: DataFrame, sparse: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query, place, key, score): both lists scaled to 0..1 among a query's own rows, a missing side counts 0."""
    every = Window.partitionBy("query")
    width = lambda c: F.max(c).over(every) - F.min(c).over(every)
    scaled = lambda df, c, name: df.select("query", "key", F.coalesce((F.col(c) - F.min(c).over(every)) / F.when(width(c) > 0, width(c)), F.lit(1.0)).alias(name))
    both = scaled(dense.withColumn("near", -F.col("distance")), "near", "a").join(scaled(sparse, "score", "b"), ["query", "key"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _first(both.select("query", "key", F.round(weight * zero("a") + (1 - weight) * zero("b"), 6).alias("score")), k)


def merge_first_each(lists: list[DataFrame]) -> DataFrame:
    """(key, list_no, query, place): where a key comes first in all lists' queries, one after the other."""
    every = None
    for no, one in enumerate(lists):
        part = one.select("key", F.lit(no).alias("list_no"), "query", "place")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.min(F.struct("list_no", "query", "place")).alias("f")).select("key", "f.*")


def best_of_app(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(key, id, similarity): for each of ``rows`` (key, app, vector) the most similar of ``centres``
    (id, app, vector) of its own app.

    Vectors have unit length; cosines are rounded to 6 decimals, ties go to the
    smaller id. Centres go out in passes; a task multiplies the rows of an app in a
    batch with the app's centres. Null apps match nothing.
    """
    sc, every, asked = ship(rows.sparkSession), None, stage(centres.where("app IS NOT NULL").select(F.col("id").alias("query"), "app", "vector"), "centres")
    for table in _passes(asked):
        apps = np.array(table.column("app").to_pylist(), object)
        shared = sc.broadcast((table.column("query").to_numpy(), _matrix(table.column("vector"), table.num_rows), {a: np.flatnonzero(apps == a) for a in set(apps)}))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wide, of = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, mine = np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2), batch.num_rows)
                for app in set(own) & set(of):
                    at, there = np.flatnonzero(own == app), of[app][np.argsort(ids[of[app]], kind="stable")]
                    for s in range(0, len(at), BLOCK):
                        cosine = np.round(mine[at[s : s + BLOCK]] @ wide[there].T, 6)
                        best = cosine.argmax(1)  # ties: the smaller id
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[s : s + BLOCK])), pa.array(ids[there[best]]), pa.array(cosine[np.arange(len(best)), best])], names=["key", "id", "similarity"])

        one = rows.select("key", "app", "vector").mapInArrow(search, "key string, id long, similarity double")
        every = one if every is None else every.unionByName(one)
    if every is None:
        return rows.sparkSession.createDataFrame([], "key string, id long, similarity double")
    best = every.groupBy("key").agg(F.max(F.struct("similarity", (-F.col("id")).alias("minus"))).alias("b"))
    return best.select("key", (-F.col("b.minus")).alias("id"), F.col("b.similarity").alias("similarity"))
