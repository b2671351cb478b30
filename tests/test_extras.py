"""Regions, pictures, change detection and file sources on hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.functions.images import change, change_udf, hellinger, histogram, histogram_distance, is_plain, picture_hash, rms, structure
from chronolens.operators.regions import assign_regions, layout_text, merge_regions, merged_boxes
from chronolens.sources import files
from chronolens.streaming.changes import keep_changes, stored_batch, stored_stream
from chronolens.streaming.sources import drain


def test_point_in_region(spark):
    texts = spark.createDataFrame([("i", 0, 10, 10, 30, 20), ("i", 1, 200, 200, 210, 210), ("j", 0, 10, 10, 30, 20)], "image string, text_no int, t_x1 int, t_y1 int, t_x2 int, t_y2 int")
    regions = spark.createDataFrame([("i", 0, 0, 0, 25, 30), ("i", 1, 15, 5, 100, 40), ("i", 2, 50, 50, 60, 60)], "image string, region_no int, r_x1 int, r_y1 int, r_x2 int, r_y2 int")
    assert [tuple(r) for r in assign_regions(texts, regions).collect()] == [("i", 0, 0)]


def test_boxes(spark):
    assert merged_boxes([(0, 0, 10, 10), (1, 1, 9, 9), (50, 50, 60, 60)]) == [(0, 0, 10, 10), (50, 50, 60, 60)]
    assert merged_boxes([(0, 0, 10, 10), (4, 0, 14, 9), (6, 0, 15, 9), (3, 3, 3, 9)]) == [(0, 0, 10, 10), (6, 0, 15, 9), (3, 3, 3, 9)]
    df = spark.createDataFrame([("a", 50, 50, 60, 60), ("a", 0, 0, 10, 10), ("a", 1, 1, 9, 9), ("a", None, 1, 1, 1)], "image string, x1 long, y1 long, x2 long, y2 long")
    assert sorted(tuple(r) for r in merge_regions(df).collect()) == [("a", 0, 0, 0, 10, 10), ("a", 1, 50, 50, 60, 60)]
    lines = spark.createDataFrame([("a", 2, 1, 1, "second"), ("a", 1, 5, 2, "right"), ("a", 1, 0, 3, "left"), ("a", 0, 0, 4, "  ")], "image string, y int, x int, id int, text string")
    assert layout_text(lines).first().text == "left\nright\nsecond"


def test_picture_measures(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, 400), rng.integers(0, 256, 400)
    assert change(a, a) == 0 and change(a, b) > 0.2 and structure(a, a) == pytest.approx(1)
    assert rms(np.array([0], np.uint8), np.array([255], np.uint8)) == 1 and is_plain(np.full(9, 7)) and not is_plain(a)
    df = spark.createDataFrame([(a.tolist(), b.tolist()), (a.tolist(), None), (a.tolist(), [1])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(change_udf(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(change(a, b)) and all(x is None or x != x for x in got[1:])
    h = spark.createDataFrame([(histogram(a).tolist(), histogram(b).tolist())], "a array<double>, b array<double>")
    one = h.select(*[histogram_distance(F.col("a"), F.col("b"), k).alias(k) for k in ("hellinger", "chi_square", "correlation")]).first()
    assert one.hellinger == pytest.approx(hellinger(histogram(a), histogram(b)))
    assert one.correlation == pytest.approx(1 - np.corrcoef(histogram(a), histogram(b))[0, 1])
    assert 0 <= spark.createDataFrame([("x",)], "p string").select(picture_hash(F.col("p"))).first()[0] < 2**60


def _captures(n=30):
    rng = np.random.default_rng(2)
    rows, now = [], rng.integers(0, 256, 64)
    for i in range(n):
        if i % 4 == 0:
            now = rng.integers(0, 256, 64)
        rows.append((f"w{i % 2}", i, f"c{i:02}", now.tolist()))
    return rows


def test_changes_stream_equals_batch(spark, tmp_path):
    shape = "key string, us long, id string, pixels array<int>"
    df = spark.createDataFrame(_captures() + [("w0", 99, "null", None)], shape)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = lambda d: sorted((r.key, r.us, r.id) for r in d.collect())
    batch = rows(stored_batch(df))
    assert len(batch) == 16 and rows(drain(stored_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in"))), "test-changes")) == batch
    assert keep_changes(None, [])[0] == []


def test_file_sources(spark, tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/q/shot_20250925_155454_090654_0.PNG").write_bytes(b"x")
    (tmp_path / "p/note.txt").write_bytes(b"x")
    got = files.pictures(spark, str(tmp_path / "p")).collect()
    assert [(r.id, r.length) for r in got] == [("20250925_155454_090654", 1)] and got[0].us % 1_000_000 == 90654
    (tmp_path / "store.json").write_text(json.dumps({"f1": {"n": 1}, "f2": {"n": None}}))
    assert {tuple(r) for r in files.json_store(spark, str(tmp_path / "store.json"), "struct<n: int>").collect()} == {("f1", 1), ("f2", None)}
    (tmp_path / "r").mkdir()
    for name in ("2026-03-24.json", "2026-03-25.json", "2026-99-99.json", "other.json"):
        (tmp_path / "r" / name).write_text("{}")
    assert [str(r.day) for r in files.reports(spark, str(tmp_path / "r/*.json")).collect()] == ["2026-03-25", "2026-03-24"]
    texts = spark.createDataFrame([("2026-03-25", "a" * 9), ("2026-03-24", "b" * 9), ("2026-03-23", "c" * 9)], "day string, text string")
    assert files.history(texts, 20).count() == 2
    for name, body, want in (("new", {"App": ["w", "w"], "Bare": []}, {("App", "w"), ("Bare", None)}), ("old", ["App"], {("App", None)})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert {tuple(r) for r in files.registry(spark, str(tmp_path / f"{name}.json")).collect()} == want


def test_merges(spark):
    shape = "frame_id string, image_path string, app string"
    old = spark.createDataFrame([("a", "video_chunk:1:2", "X"), ("b", "b.png", "Y"), ("c", "c.png", None)], shape)
    new = spark.createDataFrame([("a", "a.png", None), ("b", "window_chunk:3:4", "Z"), ("d", "d.png", "W"), ("d", "d.png", "W")], shape)
    assert {tuple(r) for r in files.merged_frames(old, new).collect()} == {("a", "video_chunk:1:2", "X"), ("b", "window_chunk:3:4", "Z"), ("c", "c.png", None), ("d", "d.png", "W")}
    assert {r.frame_id for r in files.absent_only(old, new, ["frame_id"]).collect()} == {"d"}
    assert files.add_columns(old, new.withColumn("more", F.lit(1))).columns == ["frame_id", "image_path", "app", "more"]
