"""Evaluation passages in training text: an FM-index for each shard of documents.

Documents become word numbers over the vocabulary of the test items; every run
of other words, and every document's end, is one separator that no phrase holds.
A shard of whole documents gets a suffix array, its Burrows-Wheeler transform, a
wavelet matrix for ranks and sampled suffix positions. All test phrases are
searched backwards at once; occurrences are located by walking to a sampled
position and merged into spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.sources.shipping import ship

#: Consecutive words that make a leak, words in a shard, distance of sampled positions.
PHRASE, SHARD_WORDS, SAMPLE = 12, 400_000, 16
#: Test items, and characters of them, taken in one pass; more are taken in further passes.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 20_000_000

_WORD = re.compile(r"[^\W_]+")
# soft hyphen, zero-width characters, word joiner, byte order mark
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def word_list(text: str | None) -> list[str]:
    """Words of a text in NFKC and lower case, without invisible characters."""
    if not text:
        return []
    text = text.translate(_INVISIBLE)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.lower())


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each round sorts only what is still tied."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_codes = codes[order]
    head = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        after = suffix + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 2) + second
        turn = np.argsort(key, kind="stable")
        order[at], key = suffix[turn], key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[at]
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level after the other."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
            self.zeros.append(int((bit == 0).sum()))
        self.first: dict = {}

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``i``."""
        low, high = np.zeros_like(i), i.copy()
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbol at position ``i``."""
        out, i = np.zeros_like(i), i.copy()
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Codes 1.. are words, 0 is a separator and also the end of the text."""

    def __init__(self, codes: np.ndarray, words: int):
        codes = np.append(codes, 0).astype(np.int64)
        # separators differ from one another, so no tie runs across them
        gap = np.flatnonzero(codes == 0)
        distinct = codes + len(gap)
        distinct[gap] = np.arange(len(gap))[::-1]
        order = suffix_array(distinct)
        self.bwt = WaveletMatrix(codes[order - 1], max(1, int(words).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=words + 1))])
        # positions after a separator are sampled too: a walk never crosses one
        sampled = (order % SAMPLE == 0) | (codes[order - 1] == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]
        self.n = len(codes)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases that lie right-aligned in rows, 0 to their left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for column in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[:, column]
            live = (word > 0) & (low < high)
            if live.any():
                w = word[live]
                low[live] = self.before[w] + self.bwt.rank(w, low[live])
                high[live] = self.before[w] + self.bwt.rank(w, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the next sampled one."""
        out, steps, rows = np.full(len(rows), -1), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            here = self.sample_rank[r + 1] > self.sample_rank[r]
            done = live[here]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            live = live[~here]
            r = rows[live]
            symbol = self.bwt.at(r)
            rows[live] = self.before[symbol] + self.bwt.rank(symbol, r)
            steps[live] += 1
        return out


def phrases_of(items: list[tuple[int, list[str]]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase codes, item, length): every PHRASE words of an item, or all of a shorter one."""
    rows, owner, length = [], [], []
    for item, words in items:
        codes = [vocabulary[w] for w in words]
        for s in range(max(1, len(codes) - PHRASE + 1)):
            part = codes[s : s + PHRASE]
            if part:
                rows.append([0] * (PHRASE - len(part)) + part)
                owner.append(item)
                length.append(len(part))
    return np.array(rows, np.int64).reshape(-1, PHRASE), np.array(owner, np.int64), np.array(length, np.int64)


_SPAN = "doc_id long, item_id long, first_word int, last_word int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): merged spans of each item in each document.

    A document leaks an item if it holds PHRASE consecutive words of it, or all of
    a shorter item. Word numbers count from 0. Null ids, null or empty texts and
    items without words take no part; repeated rows give the same rows once; a
    document longer than a shard makes a shard of its own. Empty tables give no rows.
    """
    spark = documents.sparkSession
    tests = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    count, chars = tests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-count // ITEMS_A_PASS), -(-chars // CHARS_A_PASS))
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for p in range(passes):
        bounded = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()
        found = _one_pass(spark, docs, [(i, word_list(t)) for i, t in zip(bounded.column("item_id").to_pylist(), bounded.column("text").to_pylist())])
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _one_pass(spark, docs: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    shared = ship(spark).broadcast((vocabulary, *phrases_of(items, vocabulary)))

    def shard(ids: list[int], codes: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        vocabulary, phrases, owner, length = shared.value
        text = np.concatenate(codes)
        if not (text > 0).any() or not len(phrases):
            return
        index = FMIndex(text, len(vocabulary))
        low, high = index.search(phrases)
        n = np.maximum(high - low, 0)
        hit = np.repeat(np.arange(len(phrases)), n)
        if not len(hit):
            return
        at = index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        ends = np.cumsum([len(c) for c in codes])
        doc = np.searchsorted(ends, at, "right")
        place = np.concatenate(places)
        first, last = place[at], place[at] + length[hit] - 1
        item = owner[hit]
        order = np.lexsort((first, item, doc))
        doc, item, first, last = doc[order], item[order], first[order], last[order]
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1)])
        heads = np.flatnonzero(fresh)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids)[doc[heads]]), pa.array(item[heads]), pa.array(first[heads].astype(np.int32)), pa.array(np.maximum.reduceat(last, heads).astype(np.int32))],
            names=["doc_id", "item_id", "first_word", "last_word"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value[0].get
        ids: list[int] = []
        codes: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.fromiter((get(w, 0) for w in word_list(text)), np.int64)
                # a run of unknown words shrinks to one separator; places keep the word numbers
                keep = np.ones(len(words), bool)
                keep[1:] = (words[1:] > 0) | (words[:-1] > 0)
                place = np.flatnonzero(keep)
                ids.append(doc_id)
                codes.append(np.append(words[place], 0))
                places.append(np.append(place, len(words)))
                held += len(place) + 1
                if held >= SHARD_WORDS:
                    yield from shard(ids, codes, places)
                    ids, codes, places, held = [], [], [], 0
        if ids:
            yield from shard(ids, codes, places)

    return docs.mapInArrow(search, _SPAN)
