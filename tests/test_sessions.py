import random
from collections import defaultdict

from chronolens.operators.islands import islands
from chronolens.operators.sessions import latest_labels, one_per_record, sessionize

GAP = 1_800_000_000


def brute(rows):
    by = defaultdict(list)
    for key, us, label in rows:
        if us is not None:
            by[key].append((us, label))
    out = []
    for key, own in by.items():
        own.sort(key=lambda x: x[0])
        held = []
        for us, label in own + [(None, None)]:
            if held and (us is None or us - held[-1][0] > GAP):
                out.append((key, held[0][0], held[-1][0], len(held), len({x[1] for x in held if x[1] is not None})))
                held = []
            held.append((us, label))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for key in ["a", "b", None]:
        t = rng.randrange(10**15)
        for _ in range(400):
            t += rng.choice([0, 1, GAP - 1, GAP, GAP + 1, GAP // 3, 5 * GAP])
            rows.append((key, t, rng.choice(["x", "y", None])))
    rows += [("a", None, "x")] + rows[:50]
    df = spark.createDataFrame(rows, "key string, us long, label string")
    got = sorted(((r.key, r.start_us, r.end_us, r.n_events, r.n_labels) for r in sessionize(df, ["key"]).collect()), key=str)
    assert got == brute(rows)


def test_gap_across_chunk_edge(spark):
    edge = 6 * 3_600_000_000
    df = spark.createDataFrame([("a", edge - GAP // 2, None), ("a", edge + GAP // 2, None), ("a", edge + GAP // 2 + GAP + 1, None)], "key string, us long, label string")
    assert sorted((r.start_us, r.n_events) for r in sessionize(df, ["key"]).collect()) == [(edge - GAP // 2, 2), (edge + GAP // 2 + GAP + 1, 1)]


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "key string, us long, label string, n_events long, start_us string")
    assert sessionize(df, ["key"]).count() == 0
    rows = spark.createDataFrame([("a", 1, "x", 7, "s")], "key string, us long, label string, n_events long, start_us string")
    assert [tuple(r) for r in sessionize(rows, ["key"]).collect()] == [("a", 1, 1, 0.0, 1, 1)]


def test_latest_labels_and_records(spark):
    df = spark.createDataFrame([("s", "Old", "2025-01-01 00:00:00"), ("s", " New ", "2025-01-02 00:00:00"), ("t", "x", "2025-01-01 00:00:00"), ("t", None, "2025-01-03 00:00:00"), (None, "y", None)], "sub_frame_id string, activity_label string, cluster_updated_at string")
    got = {tuple(r) for r in latest_labels(df.withColumn("cluster_updated_at", df.cluster_updated_at.cast("timestamp"))).collect()}
    assert got == {("s", "new"), ("t", None)}
    rows = spark.createDataFrame([("s", 1), ("s", 1), (None, 1), (None, 2), (None, 2)], "k string, v int")
    assert one_per_record(rows, "k").count() == 3


def test_islands_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(40), i, rng.choice("ab")) for i in range(300) for k in "xy"]
    df = spark.createDataFrame(rows, "k string, us long, tie long, v string")
    want = []
    for k in "xy":
        own = sorted((us, tie, v) for key, us, tie, v in rows if key == k)
        runs = []
        for us, _, v in own:
            if runs and runs[-1][0] == v:
                runs[-1][2], runs[-1][3] = us, runs[-1][3] + 1
            else:
                runs.append([v, us, us, 1])
        want += [(k, *r, runs[i + 1][1] if i + 1 < len(runs) else None) for i, r in enumerate(runs)]
    got = [(r.k, r.v, r.start_us, r.end_us, r.n, r.next_us) for r in islands(df, ["k"], "v", "tie", chunk_us=7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
