"""Clusters of an app outlast midnight and the micro-batch they began in."""

import numpy as np

from chronolens.operators.leaders import assign_leaders, leader_clusters
from chronolens.streaming.clusters import cluster_days, cluster_stream
from chronolens.streaming.sources import drain, ordered_stream

DAY = 86_400_000_000
_EVENT = "app string, day long, us long, kind int, key string, vector array<double>, label string"


def test_a_committed_group_goes_on_after_midnight(spark):
    rows = [("a", 0, i, 0, f"k{i}", [1.0, 0.1 * i], None) for i in range(4)] + [("a", 0, 1, 1, "k0", [], "mail")]
    rows += [("a", 1, DAY + 5, 0, "later", [1.0, 0.0], None), ("b", 1, DAY + 5, 0, "other", [1.0, 0.0], None)]
    events = spark.createDataFrame(rows, _EVENT)
    for df in (cluster_days(events), drain(cluster_stream(ordered_stream(events, ["us", "kind", "key"], "test-days", 2)), "test-days")):
        got = {r.key: (r.day, r.group_no, r.status, r.label) for r in df.where("kind = 0").collect()}
        assert got["later"] == (1, 0, "committed", "mail") and got["other"] == (1, 0, "pending", None)
        assert [got[f"k{i}"][1:3] for i in range(4)] == [(0, "pending"), (0, "pending"), (0, "committed"), (0, "committed")]


def test_micro_batches_follow_time(spark):
    rng = np.random.default_rng(5)
    vectors = np.eye(6)[rng.integers(0, 6, 90)] + rng.normal(0, 0.25, (90, 6))
    rows = [("a", i // 20, i // 20 * DAY + i, 0, f"k{i:03}", v.tolist(), None) for i, v in enumerate(vectors)]
    rows += [("a", i // 20, i // 20 * DAY + i + 2, 1, f"k{i:03}", [], f"label {i}") for i in range(0, 90, 4)]
    events = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], _EVENT)
    streamed = drain(cluster_stream(ordered_stream(events, ["us", "kind", "key"], "test-order", 10)), "test-order")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, cluster_days(events).collect()))
    plain = events.where("kind = 0").select("app", "day", "us", "key", "vector")
    got = drain(leader_clusters(ordered_stream(plain, ["us", "key"], "test-leaders", 10)), "test-leaders").orderBy("key").collect()
    assert [r.leader_no for r in got] == assign_leaders(vectors, 0.82).tolist()
