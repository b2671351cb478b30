import random

import numpy as np
import pytest

from chronolens.llm import leaks as L


def naive(docs, items):
    out = set()
    for d, text in docs:
        w = L.word_list(text)
        for i, t in items:
            p = L.word_list(t)
            for s in range(max(1, len(p) - 11)):
                part = p[s : s + 12]
                if part and any(w[x : x + len(part)] == part for x in range(len(w) - len(part) + 1)):
                    out.add((d, i))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        codes = rng.integers(0, 4, n)
        order = L.suffix_array(codes + 1)
        assert order.tolist() == sorted(range(n), key=lambda i: (codes[i:].tolist()))
        index = L.FMIndex(codes, 3)
        for length in (1, 2, 5):
            phrases = np.zeros((20, L.PHRASE), np.int64)
            phrases[:, L.PHRASE - length :] = rng.integers(1, 4, (20, length))
            low, high = index.search(phrases)
            for row, a, b in zip(phrases[:, L.PHRASE - length :], low, high):
                want = [i for i in range(n - length + 1) if codes[i : i + length].tolist() == row.tolist()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("shard", [50, 400_000])
def test_against_naive_search(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_WORDS", shard)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(["a", "b", "c", f"q{i}"]) for _ in range(rng.choice([3, 8, 12, 13, 40])))) for i in range(25)]
    docs = []
    for d in range(60):
        words = [rng.choice(["x", "y", "a", "zz"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            s = rng.randrange(len(w))
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[s : s + rng.randrange(1, 30)]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, items[0][1] + " ..."), (902, items[0][1] + " ..."), (None, items[0][1]), (903, "z " * 20_000 + items[1][1])]
    every = items + [(500, None), (501, ""), (502, "...")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(*i, "e") for i in every], "item_id long, text string, doc_id string")
    got = L.leaks(df, it)
    clean = [(d, t) for d, t in docs if d is not None]
    assert {(r.doc_id, r.item_id) for r in got.collect()} == naive(clean, [(i, t) for i, t in items])
    for r in got.where("doc_id = 902 AND item_id = 0").collect():
        assert (r.first_word, r.last_word) == (0, len(items[0][1].split()) - 1)


def test_text_is_normalised():
    assert L.word_list("ＮＥＶＥＲ lo­st, no​t_x") == ["never", "lost", "not", "x"]
    assert L.word_list(None) == L.word_list("") == []


def test_more_items_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_A_PASS", 3)
    items = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so word{i} other{i} it is") for i in range(10)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()} == {(i, i) for i in range(10)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert L.leaks(docs, items).count() == L.leaks(some, items).count() == 0
