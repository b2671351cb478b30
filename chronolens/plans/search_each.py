"""Searches with a query set: each text whose id is divisible by 20 asks, and with it its capture's vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.operators.many import bm25_each, fuse_ranks_each, fuse_scores_each, merge_first_each, nearest_each, text_words
from chronolens.operators.search import app_filter
from chronolens.plans.prelude import sql
from chronolens.plans.search import _WORDS, RELATED, WINDOW_APP, K, _texts
from chronolens.sources import domain
from chronolens.sources.staging import stage

STEP, LIST = 20, 50


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, query vectors); a capture asks once for each of its texts in the query set."""
    rows = stage(domain.vectors(spark, sf), "vectors")
    asking = _texts(spark, sf).where(F.col("id") % STEP == 0).select(F.col("id").alias("query"), F.col("sub_frame_id").alias("key"))
    return rows, rows.join(asking, "key").select("query", "vector")


def dense_topk_each(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_each(*_vectors(spark, sf), K)


def dense_filtered_each(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_each(*_vectors(spark, sf), K, app_filter(F.col("app"), related=RELATED, unrelated=["ledger grid"]))


def dense_windows_each(spark: SparkSession, sf: str) -> DataFrame:
    rows, asking = _vectors(spark, sf)
    windows = domain.sub_frames(spark, sf).select(F.col("sub_frame_id").alias("key"), "window_name")
    only = app_filter(F.col("app"), related=["cairn files"], include={WINDOW_APP: ["Untitled", "Untitled - Tern Mail"], "quill writer": []}, window=F.col("window_name"))
    return nearest_each(rows.join(windows, "key", "left"), asking, K, only)


def _sparse(spark: SparkSession, sf: str, key: str, k: int) -> DataFrame:
    words = stage(text_words(_texts(spark, sf).select("id", F.col(key).alias("key"), "text")), "text-words")
    return bm25_each(words, words.where(F.col("id") % STEP == 0).select(F.col("id").alias("query"), "h"), k)


def bm25_topk_each(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(spark, sf, "id", K).withColumnRenamed("key", "id")


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return nearest_each(*_vectors(spark, sf), LIST), _sparse(spark, sf, "sub_frame_id", LIST)


def hybrid_rrf_each(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_ranks_each(*_lists(spark, sf), K)


def hybrid_linear_each(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_scores_each(*_lists(spark, sf), K)


def rag_merge_each(spark: SparkSession, sf: str) -> DataFrame:
    """All dense lists in order of their queries, then all sparse ones; a key's first place counts."""
    return merge_first_each(list(_lists(spark, sf)))


QUERIES = {f.__name__: f for f in (dense_topk_each, dense_filtered_each, dense_windows_each, bm25_topk_each, hybrid_rrf_each, hybrid_linear_each, rag_merge_each)}

_PLACE = "row_number() OVER (PARTITION BY query ORDER BY {by}, key) AS place"
_DENSE = "q AS (SELECT t.id AS query, v.vector AS qv FROM tx t JOIN ve v ON v.key = t.sub_frame_id WHERE t.id % 20 = 0), de AS (SELECT query, key, app, round(list_sum(list_transform(list_zip(vector, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM ve, q {where}), dp AS (SELECT *, " + _PLACE.format(by="distance") + " FROM de)"
_BM25 = f"""w AS (SELECT id, sub_frame_id, {_WORDS} AS w FROM tx WHERE sub_frame_id IS NOT NULL AND text IS NOT NULL), d AS (SELECT id, sub_frame_id, len(w) AS length, w FROM w WHERE len(w) > 0),
    sz AS (SELECT count(*) AS texts, avg(length) AS mean FROM d), tf AS (SELECT id, word, count(*) AS tf, any_value(length) AS length FROM (SELECT id, length, unnest(w) AS word FROM d) GROUP BY 1, 2),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), qw AS (SELECT id AS query, word FROM tf WHERE id % 20 = 0),
    bm AS (SELECT query, id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (word) JOIN qw USING (word) CROSS JOIN sz GROUP BY query, id)"""
_TWO = _DENSE.format(where="") + ", " + _BM25 + ", dl AS (SELECT * FROM dp WHERE place <= 50), sl AS (SELECT * FROM (SELECT *, " + _PLACE.format(by="score DESC") + " FROM (SELECT query, sub_frame_id AS key, max(score) AS score FROM bm JOIN d USING (id) GROUP BY 1, 2)) WHERE place <= 50)"
_BEST = f"SELECT query, place, key, score FROM (SELECT *, {_PLACE.format(by='score DESC')} FROM ({{rows}})) WHERE place <= {K}"
_NEAR = f"SELECT query, place, key, app, distance FROM dp WHERE place <= {K}"
_SCALED = ", da AS (SELECT query, key, coalesce((max(distance) OVER w - distance) / nullif(max(distance) OVER w - min(distance) OVER w, 0), 1) AS a FROM dl WINDOW w AS (PARTITION BY query)), sb AS (SELECT query, key, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS b FROM sl WINDOW w AS (PARTITION BY query))"
ORACLE = {
    "dense_topk_each": sql("ve tx", f"{_DENSE.format(where='')} ;; {_NEAR}"),
    "dense_filtered_each": sql("ve tx", _DENSE.format(where="WHERE app IN ('tern mail', 'slate notes')") + f" ;; {_NEAR}"),
    "dense_windows_each": sql("ve tx su", _DENSE.format(where=f"WHERE (app = '{WINDOW_APP}' AND key IN (SELECT sub_frame_id FROM su WHERE window_name IN ('Untitled', 'Untitled - Tern Mail'))) OR app = 'quill writer'") + f" ;; {_NEAR}"),
    "bm25_topk_each": sql("tx", f"{_BM25} ;; SELECT query, place, id, score FROM (SELECT *, {_PLACE.format(by='score DESC').replace('key', 'id')} FROM bm) WHERE place <= {K}"),
    "hybrid_rrf_each": sql("ve tx", f"{_TWO} ;; " + _BEST.format(rows="SELECT query, key, round(sum(1.0 / (60 + place)), 9) AS score FROM (SELECT query, key, place FROM dl UNION ALL SELECT query, key, place FROM sl) GROUP BY 1, 2")),
    "hybrid_linear_each": sql("ve tx", f"{_TWO}{_SCALED} ;; " + _BEST.format(rows="SELECT query, key, round(0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0), 6) AS score FROM da FULL JOIN sb USING (query, key)")),
    "rag_merge_each": sql("ve tx", f"{_TWO}, f AS (SELECT key, min({{'list_no': list_no, 'query': query, 'place': place}}) AS f FROM (SELECT key, 0 AS list_no, query, place FROM dl UNION ALL SELECT key, 1, query, place FROM sl) GROUP BY key) ;; SELECT key, f.list_no AS list_no, f.query AS query, f.place AS place FROM f"),
}
