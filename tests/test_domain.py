"""The clean views: whole rows, kept in the order of time, made again when tables change."""

import shutil

from chronolens.sources import domain

_FRAME = "frame_id string, timestamp string, image_path string, device_name string, video_chunk_id long, offset_index int, monitor_id int, app_name string, focused_app_name string, focused_window_name string"
_SUB = "sub_frame_id string, window_chunk_id long, offset_index int, timestamp string, app_name string, window_name string, device_name string"


def _store(spark, folder, frames, subs):
    for name, rows, shape in (("frames", frames, _FRAME), ("sub_frames", subs, _SUB), ("devices", [("d", "UTC")], "device_name string, time_zone string")):
        shutil.rmtree(folder / f"{name}.parquet", ignore_errors=True)
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def _frame(key, at, path="p", chunk=1, app=None):
    return (key, at, path, "d", chunk, 0, 0, app, "App", "w")


def test_a_repeated_key_is_one_stored_row(spark, tmp_path):
    subs = [("s", 2, 1, "2025-10-12 00:00:00", "B", "x", "d"), ("s", 1, 9, "2025-10-12 00:00:00", "C", "a", "d"), (None, 1, 1, None, None, None, None)]
    sf = _store(spark, tmp_path, [_frame("f", "2025-10-12 00:00:01", "z", 1), _frame("f", "2025-10-12 00:00:01", "a", 9), _frame("f", "2025-10-12 00:00:01", "a", 9)], subs)
    assert [(r.image_path, r.video_chunk_id) for r in domain.frames(spark, sf).collect()] == [("a", 9)]
    assert [(r.app, r.window_name, r.window_chunk_id, r.offset_index) for r in domain.sub_frames(spark, sf).collect()] == [("b", "x", 2, 1)]


def test_time_ranges_reach_the_files_and_changes_are_seen(spark, tmp_path):
    sf = _store(spark, tmp_path, [_frame(f"f{i}", f"2025-10-12 00:00:{i:02}") for i in range(40)] + [_frame("n", "unreadable")], [])
    rows = domain.frames(spark, sf).where("us >= 1760227230000000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(us,1760227230000000)" in plan and "Exchange" not in plan
    assert rows.count() == 10 and domain.frames(spark, sf).count() == 41
    _store(spark, tmp_path, [_frame("other", "2025-10-12 00:00:00"), _frame("more", None)], [])
    assert {r.frame_id for r in domain.frames(spark, sf).collect()} == {"other", "more"}
    _store(spark, tmp_path, [], [])
    assert domain.frames(spark, sf).count() == 0 and domain.sub_frames(spark, sf).count() == 0
