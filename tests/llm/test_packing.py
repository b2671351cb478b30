import random

import numpy as np

from chronolens.llm.packing import FAN_IN, PATTERN, _going_up, best_fit, pack, token_counts


def check(spark, rows, capacity, group):
    df = spark.createDataFrame([(d, n, "c") for d, n in rows], "doc_id long, n_tokens long, container string")
    out = pack(df, capacity, group).collect()
    sizes = {}
    for d, n in rows:
        if d is not None:
            sizes[d] = max(sizes.get(d, 0), n or 0)
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by_bin[r.container] = by_bin.get(r.container, 0) + r.n_tokens
    assert {d: sum(r.n_tokens for r in p) for d, p in by_doc.items()} == sizes
    for d, p in by_doc.items():
        p.sort(key=lambda r: r.piece)
        assert [r.first_token for r in p] == [i * capacity for i in range(len(p))]
        assert len(p) == max(1, -(-sizes[d] // capacity))
        assert all((r.container is None) == (sizes[d] == 0) for r in p)
    assert all(0 < f <= capacity for f in by_bin.values())
    return by_bin


def test_nothing_is_lost_and_fill_is_high(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0, 1, 5, 99, 100, 101, 250]) if i % 3 else rng.randrange(1, 60)) for i in range(700)]
    rows += rows[:30] + [(None, 7), (9_000, None)]
    one, many = check(spark, rows, 100, 100_000), check(spark, rows, 100, 50)
    least = -(-sum(one.values()) // 100)
    assert len(one) <= 1.03 * least + 1 and len(many) <= 1.05 * least + 1


def test_same_containers_again(spark):
    rows = [(i, 1 + i * 37 % 90) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    run = lambda d: sorted(tuple(r) for r in pack(d, 100, 40).collect())
    assert run(df) == run(df.repartition(7).orderBy("n_tokens"))


def test_best_fit_is_tight():
    place = best_fit(np.array([60, 40, 50, 50, 30, 70, 100]), 100)
    assert len(set(place.tolist())) == 4
    assert best_fit(np.zeros(0, np.int64), 10).tolist() == []


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_token_counts(spark):
    import public_tokenizers as P

    assert PATTERN == P.PATTERN

    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_large_items_stay_bounded_and_small_ones_find_room(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(52, 90)) for i in range(900)] + [(1_000 + i, rng.randrange(8, 30)) for i in range(40)]
    one, many = check(spark, rows, 100, 100_000), check(spark, rows, 100, 30)  # 1 group; 32 groups, two rounds of merging
    assert len(many) <= len(one) + 2
    assert sum(2 * f <= 100 for f in many.values()) <= 1


def test_of_equal_bins_only_as_many_go_up_as_can_be_asked():
    fill = np.array([60] * 500 + [30, 100, 99])
    up = _going_up(fill, 100, 2)
    assert up[:500].sum() == 2 * FAN_IN and up[500] and not up[501] and up[502]
    assert not _going_up(fill, 100, 0).any()
