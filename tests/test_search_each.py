"""Every query of the set has its own list; passes and batches change nothing."""

import numpy as np

from chronolens.operators import many
from chronolens.plans import catalog


def test_each_query_has_its_own_list(spark, monkeypatch):
    monkeypatch.setattr(many, "A_PASS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(3)
        v = rng.normal(size=(60, 8))
        v[40:] = v[rng.integers(0, 5, 20)]  # copies: ties by key
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows = spark.createDataFrame([(f"k{i:02}", "a", x.tolist()) for i, x in enumerate(v)], "key string, app string, vector array<double>").repartition(3)
        asking = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)], "query long, vector array<double>")
        got = sorted(map(tuple, many.nearest_each(rows, asking, 6).collect()))
        want = []
        for i in range(10):
            far = np.round(((v - v[i]) ** 2).sum(1), 6)
            want += [(i, n + 1, f"k{j:02}", "a", far[j]) for n, j in enumerate(np.lexsort((np.arange(60), far))[:6])]
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_texts_of_the_set_ask(spark, sf):
    for name in ("dense_topk_each", "bm25_topk_each", "rag_merge_each"):
        ids = [r["query"] for r in catalog.QUERIES[name](spark, sf).select("query").distinct().collect()]
        assert len(ids) > 1 and all(i % 20 == 0 for i in ids)
