"""Queries of the operators on text and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm.components import components
from chronolens.llm.density import clusters, described
from chronolens.llm.edited import key_pairs, similar_pairs
from chronolens.llm.leaks import leaks
from chronolens.llm.neighbours import nearest
from chronolens.llm.packing import CAPACITY, pack, token_counts
from chronolens.llm.personal import detector, redact, spans
from chronolens.llm.subjects import subjects_of
from chronolens.sources.staging import stage
from chronolens.sources.tables import table


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sub_frame_data").select(F.col("frame_id").alias("key"), F.col("embedding").alias("vector"))


def _screen_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(screens by id, titles by sub_frame_id, distinct titles)."""
    screens = table(spark, sf, "ocr_text").select(F.lit("ocr_text").alias("table_name"), F.col("id").cast("string").alias("record_key"), "text")
    subs = table(spark, sf, "sub_frames").select("sub_frame_id", "window_name")
    return screens, subs, subs.select(F.col("window_name").alias("text")).where("text is not null").distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    screens, subs, titles = _screen_texts(spark, sf)
    model = detector(screens.select("text").unionByName(titles))
    in_screens = spans(screens, *model).select("table_name", "record_key", "kind", "start_pos")
    in_titles = spans(titles.select(F.col("text").alias("window_name"), "text"), *model).join(subs, "window_name")
    in_titles = in_titles.select(F.lit("sub_frames").alias("table_name"), F.col("sub_frame_id").alias("record_key"), "kind", "start_pos")
    return in_screens.unionByName(in_titles).withColumnRenamed("kind", "pii_kind").distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every screen text and title with typed placeholders in place of what p1_found lists."""
    screens, subs, titles = _screen_texts(spark, sf)
    model = detector(screens.select("text").unionByName(titles))
    clean = redact(titles.select(F.col("text").alias("window_name"), "text"), *model)
    named = subs.join(clean, "window_name", "left").select(F.lit("sub_frames").alias("table_name"), F.col("sub_frame_id").alias("record_key"), "text")
    return redact(screens, *model).unionByName(named).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    centroids = table(spark, sf, "activity_clusters").select(F.concat(F.lit("cluster:"), F.col("id").cast("string")).alias("key"), F.col("centroid").alias("vector"))
    pairs = nearest(_captures(spark, sf), centroids)
    return pairs.select(F.least("query", "key").alias("left_key"), F.greatest("query", "key").alias("right_key")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(_captures(spark, sf)).select(F.col("key").alias("sub_frame_id"), "cluster_key")


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size and medoids of each cluster beside what the activity tables claim for them."""
    found = stage(clusters(_captures(spark, sf)), "clusters")
    typical = described(_captures(spark, sf), found)
    typical = typical.groupBy("cluster_key", "n_members").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("typical")).withColumn("typical", F.array_join("typical", ","))
    last = table(spark, sf, "activity_assignments").groupBy(F.col("sub_frame_id").alias("key")).agg(F.max(F.struct("cluster_updated_at", "activity_cluster_id")).alias("last"))
    claims = found.join(last, "key").groupBy("cluster_key", F.col("last.activity_cluster_id").alias("claimed")).agg(F.count(F.lit(1)).alias("n"))
    claims = claims.where(F.col("claimed").isNotNull()).groupBy("cluster_key").agg(F.max(F.struct(F.col("n"), (-F.col("claimed")).alias("id"))).alias("most"))
    counts = table(spark, sf, "activity_clusters").groupBy(F.col("id").alias("claimed_cluster_id")).agg(F.max("frame_count").alias("claimed_count"))
    named = claims.select("cluster_key", (-F.col("most.id")).alias("claimed_cluster_id"), F.col("most.n").alias("n_agreeing"))
    return typical.join(named, "cluster_key", "left").join(counts, "claimed_cluster_id", "left").select("cluster_key", "n_members", "typical", "claimed_cluster_id", "n_agreeing", "claimed_count")


#: Fewest distinct words of a field's values.
_LEAST = {"text": 8, "window_name": 5}


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    screens = table(spark, sf, "ocr_text").select(F.lit("text").alias("field_name"), F.col("id").cast("string").alias("key"), "text")
    titles = table(spark, sf, "sub_frames").select(F.lit("window_name").alias("field_name"), F.col("window_name").alias("key"), F.col("window_name").alias("text")).distinct()
    return screens.unionByName(titles)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return key_pairs(*similar_pairs(_texts(spark, sf), _LEAST)).distinct()


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each text that has a near-duplicate: its group, the other word sets it
    is similar to and the keys that share its own."""
    members, pairs = similar_pairs(_texts(spark, sf), _LEAST)
    pairs = stage(pairs.select("left", "right"), "similar-sets")
    roots = components(pairs.select(F.col("right").alias("a"), F.col("left").alias("b")))
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    links = both.groupBy(F.col("left").alias("c1")).agg(F.count(F.lit(1)).alias("n_similar_sets"))
    same = members.groupBy("c1").agg(F.count(F.lit(1)).alias("n_same_set"), F.min("key").alias("least_key"))
    sets = same.join(links, "c1", "left").join(roots.withColumnRenamed("node", "c1"), "c1", "left").where((F.col("n_same_set") > 1) | F.col("root").isNotNull())
    sets = sets.withColumn("root", F.coalesce("root", "c1"))
    named = sets.groupBy("root").agg(F.min("least_key").alias("group_key"))
    return members.join(sets, "c1").join(named, "root").select("field_name", "key", "group_key", F.coalesce("n_similar_sets", F.lit(0)).alias("n_similar_sets"), "n_same_set")


P6_SQL = r"""
WITH docs AS (SELECT 'text' AS field_name, id::VARCHAR AS key, text FROM ocr_text
              UNION SELECT DISTINCT 'window_name', window_name, window_name FROM sub_frames),
w AS (SELECT DISTINCT field_name, key, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM docs WHERE text IS NOT NULL),
s AS (SELECT *, len(w) AS n FROM w WHERE len(w) >= CASE field_name WHEN 'text' THEN 8 ELSE 5 END)
SELECT DISTINCT a.field_name, a.key AS left_key, b.key AS right_key FROM s a JOIN s b ON a.field_name = b.field_name AND a.key < b.key
    AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7
WHERE len(list_intersect(a.w, b.w)) * 17 >= (a.n + b.n) * 7
"""

P7_SQL = """
WITH caps AS (SELECT DISTINCT frame_id AS key, embedding::DOUBLE[] AS v FROM sub_frame_data WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
qs AS (SELECT key, v, true AS own FROM caps UNION ALL
       SELECT DISTINCT 'cluster:' || id, centroid::DOUBLE[], false FROM activity_clusters WHERE len(centroid) = 64 AND list_sum(list_transform(centroid, lambda x: abs(x))) > 0),
sims AS (SELECT q.key AS q, c.key AS c, round(list_cosine_similarity(q.v, c.v), 6) AS s FROM qs q JOIN caps c ON q.key <> c.key),
best AS (SELECT q, c FROM sims WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) <= 5)
SELECT DISTINCT least(q, c) AS left_key, greatest(q, c) AS right_key FROM best
"""

#: Where the public tokenizers lie; a session may name another folder.
_TOKENIZERS = ("spark.chronolens.tokenizers", "/opt/tokenizers")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(token_counts(table(spark, sf, "documents"), f"{spark.conf.get(*_TOKENIZERS)}/byte_bpe_50k.tiktoken"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, by tenths; the total shows the space left unused."""
    bins = _packed(spark, sf).where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("items"))
    tenth = F.least(F.floor(F.col("fill") * 10 / CAPACITY), F.lit(9)).alias("tenth")
    return bins.groupBy(tenth).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("n_tokens"), F.sum(CAPACITY - F.col("fill")).alias("unused"), F.sum("items").alias("n_pieces"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing, as counts: every document once and whole, no container
    overfull, no document cut that fits, full pieces before a rest, one container at most
    that is half empty."""
    pieces = stage(_packed(spark, sf), "packing")
    docs = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count(F.when(F.col("first_token") != F.col("piece") * CAPACITY, 1)).alias("off"))
    bins = pieces.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    broken = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last") + 1) | (F.col("off") > 0)
    needless = (F.col("pieces") > 1) & (F.ceil(F.col("n") / CAPACITY) != F.col("pieces"))
    half = F.count(F.when(F.col("fill") * 2 <= CAPACITY, 1))
    return (
        docs.select(F.lit("documents").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(docs.agg(F.count(F.when(broken, 1)).alias("n")).select(F.lit("documents with gaps").alias("what"), "n"))
        .unionByName(docs.agg(F.count(F.when(needless, 1)).alias("n")).select(F.lit("documents cut without need").alias("what"), "n"))
        .unionByName(bins.agg(F.count(F.when(F.col("fill") > CAPACITY, 1)).alias("n")).select(F.lit("overfull containers").alias("what"), "n"))
        .unionByName(bins.agg(F.greatest(half - 1, F.lit(0)).alias("n")).select(F.lit("half empty containers beyond one").alias("what"), "n"))
    )


P8_CHECKS_SQL = """
SELECT 'documents' AS what, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'documents with gaps', 0 UNION ALL SELECT 'documents cut without need', 0
UNION ALL SELECT 'overfull containers', 0 UNION ALL SELECT 'half empty containers beyond one', 0
"""


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects_of(table(spark, sf, "documents"), table(spark, sf, "subjects"), table(spark, sf, "subject_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject_code")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and sentences of each subject, by kind of document."""
    kinds = table(spark, sf, "documents").select("doc_id", "doc_kind")
    found = _subjects(spark, sf).join(kinds, "doc_id")
    return found.groupBy("doc_kind", "subject_code").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


_P4 = """v AS MATERIALIZED (SELECT DISTINCT frame_id AS key, embedding::DOUBLE[] AS v FROM sub_frame_data WHERE frame_id IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
e AS MATERIALIZED (SELECT DISTINCT a.key AS a, b.key AS b FROM v a JOIN v b ON a.key <> b.key WHERE list_cosine_similarity(a.v, b.v) >= 0.8),
r AS (SELECT DISTINCT a AS key, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key),
f AS (SELECT key AS sub_frame_id, min(root) AS cluster_key FROM r GROUP BY key)"""
P4_SQL = f"WITH RECURSIVE {_P4} SELECT * FROM f"
P4_CLUSTERS_SQL = f"""WITH RECURSIVE {_P4},
u AS (SELECT f.cluster_key, v.key, list_transform(v.v, lambda x: x / sqrt(list_sum(list_transform(v.v, lambda y: y * y)))) AS u FROM f JOIN v ON v.key = f.sub_frame_id),
s AS (SELECT cluster_key, list(x ORDER BY i) AS s FROM (SELECT cluster_key, i, sum(u[i]) AS x FROM u, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT cluster_key, count(DISTINCT key) AS n_members, count(*) AS n FROM u GROUP BY 1),
t AS (SELECT u.cluster_key, u.key, n_members, row_number() OVER (PARTITION BY u.cluster_key ORDER BY round(list_dot_product(u.u, s.s) / n, 9) DESC, u.key) AS place FROM u JOIN s USING (cluster_key) JOIN n USING (cluster_key)),
l AS (SELECT sub_frame_id, activity_cluster_id AS claimed FROM activity_assignments QUALIFY row_number() OVER (PARTITION BY sub_frame_id ORDER BY cluster_updated_at DESC NULLS LAST, activity_cluster_id DESC NULLS LAST) = 1),
c AS (SELECT cluster_key, claimed, count(*) AS n FROM f JOIN l USING (sub_frame_id) WHERE claimed IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY count(*) DESC, claimed) = 1),
k AS (SELECT id, max(frame_count) AS claimed_count FROM activity_clusters GROUP BY 1),
m AS (SELECT cluster_key, n_members, string_agg(key, ',' ORDER BY place) AS typical FROM t WHERE place <= 3 GROUP BY 1, 2)
SELECT m.cluster_key, n_members, typical, c.claimed AS claimed_cluster_id, c.n AS n_agreeing, claimed_count FROM m LEFT JOIN c USING (cluster_key) LEFT JOIN k ON k.id = c.claimed
"""

P6_GROUPS_SQL = r"""
WITH RECURSIVE docs AS (SELECT 'text' AS field_name, id::VARCHAR AS key, text FROM ocr_text UNION SELECT DISTINCT 'window_name', window_name, window_name FROM sub_frames),
w AS (SELECT DISTINCT field_name, key, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS w FROM docs WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT *, len(w) AS n FROM w WHERE len(w) >= CASE field_name WHEN 'text' THEN 8 ELSE 5 END),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY field_name, w) AS id, * FROM (SELECT field_name, w, len(w) AS n, min(key) AS least_key, count(*) AS n_same_set FROM s GROUP BY 1, 2)),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.field_name = b.field_name AND a.id <> b.id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7 WHERE len(list_intersect(a.w, b.w)) * 17 >= (a.n + b.n) * 7),
r AS (SELECT id, id AS root FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id), m AS (SELECT a, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT c.*, coalesce(m.n, 0) AS n_similar_sets, min(least_key) OVER (PARTITION BY root) AS group_key FROM c JOIN g USING (id) LEFT JOIN m ON m.a = c.id)
SELECT s.field_name, s.key, group_key, n_similar_sets, n_same_set FROM s JOIN k ON k.field_name = s.field_name AND k.w = s.w WHERE n_same_set > 1 OR n_similar_sets > 0
"""

# DuckDB has no NFKC: wide letters and the ligatures are rewritten one by one
_P9_WORDS = "list_filter(string_split_regex(lower(translate(replace(replace(regexp_replace(text, '[\\x{00AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '" + "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''") + "', '" + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + "')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_P9 = f"""items AS MATERIALIZED (SELECT DISTINCT item_id, {_P9_WORDS} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 12) AS n, array_to_string(w[k + 1 : k + least(len(w), 12)], ' ') AS g FROM items, unnest(range(greatest(len(w) - 11, 1))) t(k) WHERE len(w) > 0),
docs AS (SELECT DISTINCT doc_id, {_P9_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT DISTINCT d.doc_id, i.item_id, k AS first_word, k + i.n - 1 AS last_word FROM (SELECT doc_id, l.n, k, array_to_string(w[k + 1 : k + l.n], ' ') AS g FROM docs, (SELECT DISTINCT n FROM i) l, unnest(range(len(w) - l.n + 1)) t(k)) d JOIN i ON i.n = d.n AND i.g = d.g)"""
P9_SQL = f"WITH {_P9} SELECT DISTINCT doc_id, item_id FROM h"
P9_SPANS_SQL = f"""WITH {_P9},
m AS (SELECT *, CASE WHEN first_word > max(last_word) OVER (PARTITION BY doc_id, item_id ORDER BY first_word, last_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM h),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY first_word, last_word ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT doc_id, item_id, min(first_word) AS first_word, max(last_word) AS last_word FROM n GROUP BY doc_id, item_id, no
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
ORACLE = {
    "p4_found": P4_SQL, "p4_clusters": P4_CLUSTERS_SQL, "p6_found": P6_SQL, "p6_groups": P6_GROUPS_SQL, "p7_found": P7_SQL, "p8_checks": P8_CHECKS_SQL, "p9_found": P9_SQL, "p9_spans": P9_SPANS_SQL,
}
