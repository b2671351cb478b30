import random

from pyspark.sql import functions as F

from chronolens.operators.references import match_runs, orphans, parent_runs, tidy_key


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape).withColumn("ref_key", tidy_key(F.col("ref_key")))


def run(spark, refs, parents, deleted):
    r = frame(spark, refs, "record_key string, ref_key string, created_us long")
    p = frame(spark, parents, "ref_key string, created_us long")
    d = frame(spark, deleted, "ref_key string")
    return {tuple(x) for x in orphans(r, p, d).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [str(n) for n in list(range(-2, 60)) + [10**17 + i for i in range(5)]] + [f"sub_{h:03x}_{i}" for h in range(30) for i in range(3)] + ["007", "7", "key", "Key ", "9" * 25]
    parents = [(k, rng.choice([None, rng.randrange(100)])) for k in rng.sample(pool, 80) for _ in range(rng.choice([1, 1, 2]))]
    refs = [(str(i), rng.choice(pool + [None, "", "  "]), rng.choice([None, rng.randrange(100)])) for i in range(600)]
    deleted = [(k,) for k in rng.sample(pool, 40)] + [(None,)]
    tidy = lambda k: k.strip().lower()
    stored = {}
    for k, t in parents:
        stored.setdefault(tidy(k), []).append(t)
    want = set()
    for key, ref, t in refs:
        if ref is None or not tidy(ref):
            continue
        k = tidy(ref)
        if k in stored:
            times = [x for x in stored[k] if x is not None]
            if times and t is not None and min(times) > t:
                want.add((key, k, "late", "1970-01"))
        else:
            want.add((key, k, "deleted" if k in {tidy(d[0]) for d in deleted if d[0]} else "absent", "unknown" if t is None else "1970-01"))
    assert run(spark, refs, parents, deleted) == want


def test_empty_tables(spark):
    assert run(spark, [], [("1", 1)], []) == set()
    assert run(spark, [("a", "1", 1)], [], []) == {("a", "1", "absent", "1970-01")}


def test_hot_key_and_runs(spark):
    assert len(run(spark, [(str(i), "5", 1) for i in range(2000)], [("4", 1), ("6", 1)], [("5",)])) == 2000
    keys = frame(spark, [(str(i), 1) for i in [1, 2, 3, 7, 8, 70_000]], "ref_key string, created_us long")
    runs = parent_runs(keys)
    assert sorted((r.first_number, r.last_number) for r in runs.collect()) == [(1, 3), (7, 8), (70_000, 70_000)]
    probe = spark.createDataFrame([("2", 1), ("5", 1), ("9", 1), ("0", 1)], "ref_key string, oldest_ref_us long")
    assert {(r.ref_key, r.present) for r in match_runs(probe, runs).collect()} == {("2", True), ("5", False), ("9", False), ("0", False)}
