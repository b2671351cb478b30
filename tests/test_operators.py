"""Micro-fixtures with results worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolens.functions.text import estimated_tokens, same_activity, tokens
from chronolens.operators.focus import scores, streaks
from chronolens.operators.leaders import anchor_groups, assign_leaders, last_kept, token_chunks
from chronolens.operators.search import app_filter, merge_first, merge_ranges
from chronolens.streaming.clusters import AppClusters, cluster_days, cluster_stream, named_followers, replay
from chronolens.streaming.sessions import extend, online_sessions, runs
from chronolens.streaming.sources import UpdateLog, drain, latest_rows


def test_focus_day(spark):
    rows = [("d", f"f{i:02}", i * 300_000_000, a) for i, a in enumerate("AAAAABCCCCBA")]
    streak = streaks(spark.createDataFrame(rows, "device_name string, frame_id string, us long, app string"), 300)
    assert [r.minutes for r in streak.orderBy("start_us").collect()] == [25, 5, 20, 5, 5]
    s = scores(streak).first()
    assert (s.score, s.switches, s.total_minutes, s.deep_minutes, s.longest_minutes, s.average_minutes) == (68, 4, 60, 45, 25, 12)
    assert scores(streak.limit(0)).count() == 0


def test_leaders():
    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.5, 0.5], [0.2, 0.9]])
    assert assign_leaders(v, 0.82).tolist() == [0, 0, 1, 2, 1]
    assert assign_leaders(np.zeros((2, 3)), 0.5).tolist() == [0, 1]


def test_sequences():
    assert last_kept(np.array([0, 4, 8, 12.0]), 5).tolist() == [True, False, True, False]
    assert anchor_groups(np.array([0, 400, 900, 1300, 1800, 2900]), 1000).tolist() == [0, 0, 0, 1, 1, 2]
    starts, ends, costs = [540, 545, 570, 581], [545, 552, 580, 590], [23, 24, 23, 23]
    assert token_chunks(costs, starts, ends, 30_000, 10) == [0, 0, 1, 1]
    assert token_chunks(costs, starts, ends, 40, 10) == [0, 1, 2, 3]
    assert token_chunks(costs, starts, ends, 46, 60) == [0, 1, 2, 2]


def test_online_session_rule():
    us, what = [600, 601, 720, 725, 726], ["c1", "c1", "c2", "c2", "c1"]
    assert runs(np.array(us), np.array(what, object)) == [(600, 601, "c1", 2), (720, 725, "c2", 2), (726, 726, "c1", 1)]
    touched, state = extend(None, runs(np.array(us), np.array(what, object)))
    assert extend(None, [(u, u, w, 1) for u, w in zip(us, what)]) == (touched, state)
    assert [t[1:] for t in touched] == [["c1", 600, 601, 2], ["c2", 720, 725, 2], ["c1", 726, 726, 1]]
    late, _ = extend(state, [(660, 660, "c1", 1)])
    assert late == [[3, "c1", 660, 660, 1]]


def test_tokens_and_labels(spark):
    text = "ab abc _x1y 中文字 foo_bar 字 9abc The the"
    df = spark.createDataFrame([(text,)], "t string")
    assert sorted(df.select(tokens(F.col("t"))).first()[0]) == sorted(["abc", "_x1y", "foo_bar", "abc", "中文字"])
    assert df.select(tokens(F.lit(None).cast("string"))).first()[0] == []
    pairs = [("Write Code", "write-code", True), ("read mails today", "read mail", True), ("edit", "tide", True), ("cook", "read mail", False), ("", "read mail", False)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select(same_activity(F.col("a"), F.col("b")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]
    assert spark.createDataFrame([("",), ("ab",), ("abcdef",), (None,)], "t string").select(estimated_tokens(F.col("t"))).toPandas().iloc[:, 0].tolist() == [0, 1, 2, 0]


def test_range_merge(spark):
    rows = [(10, 12, 11, 13), (10, 11, 12, 13), (None, None, 9, 12), (10, None, 9, 12)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = [tuple(r) for r in df.select(*merge_ranges(*map(F.col, "abcd"))).collect()]
    assert got == [(11, 12), (10, 11), (9, 12), (10, 12)]


@pytest.mark.parametrize(
    "options, want",
    [
        ({"related": ["X"]}, {1, 2}), ({"related": ["X"], "unrelated": ["Y"]}, {1, 2}), ({"unrelated": ["Y"]}, {1, 2, 4, 5}),
        ({"include": {"X": ["w1"]}, "related": ["Z"]}, {1}), ({"include": {"X": []}}, {1, 2}), ({"exclude": {"X": ["w1"]}}, {2, 3, 4, 5}), ({}, {1, 2, 3, 4, 5}),
    ],
)
def test_app_filter(spark, options, want):
    df = spark.createDataFrame([(1, "X", "w1"), (2, "X", "w2"), (3, "Y", "w1"), (4, "", "w1"), (5, None, None)], "k int, app string, w string")
    assert {r.k for r in df.where(app_filter(F.col("app"), window=F.col("w"), **options)).collect()} == want


def test_merge_first(spark):
    ranked = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, place int")
    got = merge_first([ranked("ab"), ranked("bc"), ranked("cd")]).orderBy("place").collect()
    assert [(r.key, r.list_no) for r in got] == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def _events(rng, n):
    centres = np.eye(4)
    rows = []
    for i in range(n):
        v = centres[rng.integers(4)] + rng.normal(0, 0.1, 4)
        rows.append(("a", 1, i * 1_000_000, 0, f"k{i:03}", v.tolist(), None))
        if i % 9 == 0:
            rows.append(("a", 1, i * 1_000_000 + 1, 1, f"k{i:03}", [], f"label {i}"))
    return rows


_EVENT = "app string, day long, us long, kind int, key string, vector array<double>, label string"


def test_online_clusters_promote(spark):
    app = AppClusters()
    rows = pd.DataFrame(_events(np.random.default_rng(0), 60), columns=[f.split()[0] for f in _EVENT.split(", ")])
    out = replay(app, rows)
    assert sum(r[2] == 0 for r in out) == 60 and len(app.groups) <= 8 and "committed" in {g.status for g in app.groups}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_events(np.random.default_rng(1), 40), _EVENT)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streamed = drain(cluster_stream(stream), "test-clusters")
    key = lambda d: sorted((r.key, r.group_no, r.status) for r in d.collect())
    assert key(streamed) == key(cluster_days(df))


def test_followers_are_named_with_their_leader(spark):
    rows = [("a", 0, i, 0, f"k{i}", [1.0, 0.1 * i], None) for i in range(4)] + [("a", 0, 2, 1, "k0", [], "mail"), ("b", 0, 1, 0, "x", [1.0, 0.0], None)]
    got = {r.key: (r.status, r.label) for r in named_followers(cluster_days(spark.createDataFrame(rows, _EVENT))).collect()}
    assert got == {"k0": ("committed", "mail"), "k1": ("committed", "mail"), "k2": ("committed", "mail"), "k3": ("committed", "mail"), "x": ("pending", None)}


def test_online_sessions_across_batches(spark, tmp_path):
    shape = "device_name string, app string, us long, what string"
    for i, rows in enumerate([[("d", "a", 1, "x"), ("d", "a", 2, "x"), (None, "a", 2, "y")], [("d", "a", 3, "x"), ("d", "a", 0, "x"), (None, "a", 5, "y"), (None, None, 5, "y")]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(online_sessions(stream), "test-sessions").collect()
    assert {(r.device_name, r.app, r.what) for r in got} == {("d", "a", "x"), (None, "a", "y")}
    assert sum(n for n in [max(r.n for r in got if r.device_name == "d" and r.session == s) for s in {r.session for r in got if r.device_name == "d"}]) == 4


def test_updates_of_repeated_batches_count_once(spark):
    batch = lambda rows: spark.createDataFrame(rows, "k string, v int")
    log = UpdateLog(batch([]), "test-updates")
    log.apply(batch([("a", 1), ("a", 2), ("b", 1)]), 0)
    log.apply(batch([("b", 99)]), 1)
    log.apply(batch([("b", 5), ("c", None)]), 1)  # run again
    rows = spark.read.schema("k string, v int, batch long").parquet(log.base)
    assert {tuple(r) for r in latest_rows(rows, ["k"], ["batch"]).drop("batch").collect()} == {("a", 2), ("b", 5), ("c", None)}
