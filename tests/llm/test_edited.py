import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chronolens.llm import edited
from chronolens.llm.arrow_groups import blocks
from chronolens.llm.edited import Forest, key_pairs, similar_pairs, sketches, word_sets

LEAST = {"t": 3, "u": 2}


def brute(rows, floor=0.7):
    sets = {}
    for field, key, text in rows:
        if text is None or key is None:
            continue
        w = frozenset(x for x in re.split(r"[\W_]+", text.lower()) if x)
        if len(w) >= LEAST[field]:
            sets[field, key] = w
    keys = sorted(sets)
    return {(f, a, b) for i, (f, a) in enumerate(keys) for g, b in keys[i + 1 :] if f == g and len(sets[f, a] & sets[f, b]) * 10 >= 7 * len(sets[f, a] | sets[f, b])}


def made(seed, n=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            t = rng.choice(base).split()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rng.shuffle(t)
        else:
            t = rng.sample(words, rng.randrange(3, 25))
        base.append(" ".join(t))
        rows.append((rng.choice("tu"), f"k{i:03}", base[-1]))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "field_name string, key string, text string, c1 string, n int")
    return {tuple(r) for r in key_pairs(*similar_pairs(df, LEAST)).distinct().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    rows += rows[:20] + [("t", "null", None), ("t", None, "a b c d"), ("t", "empty", ""), ("t", "blank", "  .. "), ("t", "few", "a b")]
    rows += [("t", "long1", " ".join(f"x{i}" for i in range(4000))), ("t", "long2", " ".join(f"x{i}" for i in range(20, 4000)))]
    assert run(spark, rows) == brute(rows)


def test_large_shards_are_cut(spark, monkeypatch):
    monkeypatch.setattr(edited, "SHARD_MAX", 16)
    rng = random.Random(7)
    rows = [("t", f"k{i:03}", " ".join(["same", "words", "stay", "here", "now"] + ([rng.choice("abc")] if i % 2 else []))) for i in range(60)] + made(3, 120)
    rows = [(f, k if i < 60 else f"m{i}", t) for i, (f, k, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_sketch_never_exceeds_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(-(2**31), 2**31, 30, dtype=np.int64).astype(np.int32)
        b = np.concatenate([a[:22], rng.integers(-(2**31), 2**31, 5, dtype=np.int64).astype(np.int32)])
        h, row = np.concatenate([a, b]), np.repeat([0, 1], [30, 27])
        s1, s2 = sketches(h, row, 2)
        d = np.bitwise_count(s1[0] ^ s1[1]) + np.bitwise_count(s2[0] ^ s2[1])
        assert d <= len(set(a) ^ set(b))


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    shard = np.sort(rng.integers(0, 6, 300))
    shard = np.cumsum(np.diff(shard, prepend=shard[0]) != 0)
    s1, s2 = (rng.integers(0, 2**12, 300).astype(np.uint64) for _ in range(2))
    forest = Forest(shard, s1, s2)
    radius = rng.integers(0, 6, 300)
    got = {(int(q), int(n)) for a, b, _ in forest.search(shard, s1, s2, radius) for q, n in zip(a, b)}
    d = np.bitwise_count(s1[:, None] ^ s1) + np.bitwise_count(s2[:, None] ^ s2)
    want = {(i, j) for i in range(300) for j in range(300) if shard[i] == shard[j] and d[i, j] <= radius[i]}
    assert got == want


def test_texts_are_read_and_split_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = made(5, 80)
    df = spark.createDataFrame(rows, "field_name string, key string, text string")
    found = key_pairs(*similar_pairs(df.mapInArrow(note, df.schema), LEAST)).distinct()
    assert {tuple(r) for r in found.collect()} == brute(rows)
    assert seen.value == len(rows)
    assert word_sets(df, LEAST)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_pair_is_found_by_few_shards():
    # two sets of 20 words that share all but the last: seven of their rarest words are entries
    n = np.full(2, 20)
    at = [len(list(edited._pairs(np.zeros(2, int), np.array([1, 2]), n, np.full(2, place), np.zeros(2, np.uint64), np.zeros(2, np.uint64), 7, 10))) for place in range(7)]
    assert at == [1, 1, 1, 1, 0, 0, 0]


def test_blocks_are_whole_groups():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["k"]) for x in np.split(keys, [0, 7, 150, 151, 400])]
    found = [t.column("k").to_numpy() for t in blocks(iter(batches), "k", 60)]
    assert np.array_equal(np.concatenate(found), keys) and len(found) > 3
    assert all(a[-1] < b[0] for a, b in zip(found, found[1:]))
    assert list(blocks(iter([]), "k", 60)) == []
