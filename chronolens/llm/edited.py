"""Near-duplicates with small edits: BK-trees over parity sketches.

A text is its set of distinct words. Each word flips one bit of a 128-bit
sketch, so the Hamming distance of two sketches never exceeds the number of
words that only one of the texts has, and texts of sizes m and n with Jaccard
similarity t differ in at most (m + n)(1 - t) / (1 + t) words. A search with
that radius therefore misses no pair.

Shards: two texts that similar share a word among their rarest few, so the
entries of one such word are a shard. Word counts are kept in a table of fixed
size; any order of the words is exact, counts only make it quick. Every shard
has one BK-tree, built and searched level by level for all shards of a batch at
once. A shard beyond SHARD_MAX entries is cut into parts, and every pair of
parts meets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolens.llm.arrow_groups import blocks, grouped
from chronolens.sources.shipping import ship
from chronolens.sources.staging import drop, stage, stage_parts

#: Slots of the word-count table (int32, so 1 MB is broadcast) and of a shard.
SLOTS, SHARD_MAX = 1 << 18, 4_096


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters or digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def word_sets(rows: DataFrame, least: dict[str, int]) -> DataFrame:
    """(field_name, key, n, h, c1): hashed distinct words of each row with enough of them.

    ``rows`` has (field_name, key, text). Words of different fields never hash
    alike on purpose, so fields do not meet. c1 stands for the whole set. A word
    is 32 bits: that two of a pair's some 80 words agree in them has a chance of
    one in a million, and it matters only to a pair one word from the floor.
    What explode makes, Spark does not work out again for the filter on its size.
    """
    enough = None
    for name, n in least.items():
        enough = F.when(F.col("field_name") == name, n) if enough is None else enough.when(F.col("field_name") == name, n)
    sets = rows.where(F.col("text").isNotNull() & F.col("key").isNotNull()).select("field_name", "key", F.explode(F.array(words(F.col("text")))).alias("w"))
    sets = sets.where(F.size("w") >= enough)
    hashes = F.sort_array(F.transform("w", lambda w: F.hash(F.col("field_name"), w)))
    return sets.select("field_name", "key", F.size("w").alias("n"), hashes.alias("h")).withColumn("c1", F.xxhash64("h"))


def slot_counts(classes: DataFrame) -> np.ndarray:
    """How many sets hold a word of each slot: a table of fixed size, whatever the input."""
    slots = classes.select(F.explode("h").alias("w")).groupBy(F.pmod("w", F.lit(SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    found = slots.toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit parity sketch of each row's hashes, as two columns of 64 bits."""
    bit = (h.view(np.uint32) >> np.uint32(25)).astype(np.int64)
    odd = np.bincount(row * 128 + bit, minlength=rows * 128).astype(np.uint8) & 1
    packed = np.packbits(odd.reshape(rows, 128), axis=1).view(np.uint64)
    return packed[:, 0], packed[:, 1]


def _rarest(batch: pa.RecordBatch, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, place, rarity) of each set's rarest words that others may share; a set's
    words are placed from the rarest on. The batch has columns n and h."""
    n = batch.column("n").to_numpy().astype(np.int64)
    h, row = _flat(batch.column("h"))
    rarity = counts[h % SLOTS]
    order = np.argsort(rarity.astype(np.int64) << 32 | h.view(np.uint32))
    order = order[np.argsort(row[order].astype(np.uint16 if len(n) < 65_536 else np.int64), kind="stable")]
    h, rarity = h[order], rarity[order]
    place = np.arange(len(h)) - (np.cumsum(n) - n)[row]
    keep = (place < (n - (-(-n * up // down)) + 1)[row]) & (rarity > 1)
    return h[keep], row[keep], place[keep], rarity[keep]


def entries(classes: DataFrame, shared: Broadcast, floor: tuple[int, int]) -> DataFrame:
    """(token, c1, n, place, s1, s2): one entry for each of a set's rarest words that others may share."""
    up, down = floor

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s1, s2 = sketches(*_flat(batch.column("h")), batch.num_rows)
            token, at, place, _ = _rarest(batch, shared.value, up, down)
            c1, n = batch.column("c1").to_numpy(), batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c1[at]), pa.array(n[at]), pa.array(place.astype(np.int32)), pa.array(s1[at].view(np.int64)), pa.array(s2[at].view(np.int64))], names=["token", "c1", "n", "place", "s1", "s2"])

    return classes.select("c1", "n", "h").mapInArrow(cut, "token int, c1 long, n int, place int, s1 long, s2 long")


def large_shards(classes: DataFrame, shared: Broadcast, floor: tuple[int, int]) -> DataFrame:
    """(token, parts) of the shards beyond SHARD_MAX; only words of fuller slots can have one."""
    (up, down), most = floor, SHARD_MAX

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                token, _, _, rarity = _rarest(batch, shared.value, up, down)
                yield pa.RecordBatch.from_arrays([pa.array(token[rarity > most])], names=["token"])

    sizes = classes.select("n", "h").mapInArrow(cut, "token int").groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
    return stage(sizes.select("token", F.ceil(F.col("m") / most).cast("int").alias("parts")), "large-shards")


class Forest:
    """BK-trees of many shards at once. Arrays are sorted by shard; ``shard`` numbers
    them from 0. Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, shard: np.ndarray, s1: np.ndarray, s2: np.ndarray):
        self.s1, self.s2 = s1, s2
        n = len(shard)
        self.root = np.flatnonzero(np.diff(shard, prepend=-1))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at = self.root[shard]
        todo = np.flatnonzero(at != np.arange(n))
        at = at[todo]
        while len(todo):
            d = self.distance(todo, at)
            order = np.lexsort((todo, d, at))
            todo, at, d = todo[order], at[order], d[order]
            head = np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])])
            child = todo[head]
            parent[child], edge[child] = at[head], d[head]
            below = child[np.cumsum(head) - 1]
            todo, at = todo[~head], below[~head]
        children = np.flatnonzero(parent >= 0)
        order = np.lexsort((edge[children], parent[children]))
        self.child = children[order]
        # one sorted key for (parent, edge): a range of edges is a slice of children
        self.key = parent[self.child] * 1024 + edge[self.child]

    def distance(self, a: np.ndarray, b: np.ndarray, t1: np.ndarray | None = None, t2: np.ndarray | None = None) -> np.ndarray:
        t1, t2 = (self.s1, self.s2) if t1 is None else (t1, t2)
        return np.bitwise_count(t1[a] ^ self.s1[b]).astype(np.int64) + np.bitwise_count(t2[a] ^ self.s2[b])

    def search(self, shard: np.ndarray, t1: np.ndarray, t2: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) within each query's radius, following only edges within it."""
        query = np.arange(len(shard))
        node = self.root[shard]
        radius = np.minimum(radius, 128)  # no two sketches are further apart
        while len(query):
            d = self.distance(query, node, t1, t2)
            hit = d <= radius[query]
            if hit.any():
                yield query[hit], node[hit], d[hit]
            low = np.searchsorted(self.key, node * 1024 + np.maximum(d - radius[query], 0), "left")
            high = np.searchsorted(self.key, node * 1024 + d + radius[query], "right")
            n = high - low
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, node = np.repeat(query, n), self.child[np.repeat(low, n) + step]


def _radius(m: np.ndarray, n: np.ndarray, up: int, down: int) -> np.ndarray:
    return (m + n) * (down - up) // (down + up)


def _pairs(shard: np.ndarray, c1: np.ndarray, n: np.ndarray, place: np.ndarray, s1: np.ndarray, s2: np.ndarray, up: int, down: int, tree: np.ndarray | None = None, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class pairs within the radius that their sizes allow. ``tree``: the rows that the
    trees may hold, ``asks``: those that search them; all rows, if not given.

    The larger set of a pair asks for the smaller one. The first word that they
    share, from the rarest on, has in each of them as many words from there on as
    they share, so the smaller one has it among fewer words still: only those are
    in trees, and a pair that meets at a later place is left to an earlier word.
    """
    tree = np.arange(len(shard)) if tree is None else tree
    asks = np.arange(len(shard)) if asks is None else asks
    tree = tree[(n[tree] - place[tree]) * (up + down) >= 2 * n[tree] * up]
    if not len(tree):
        return
    held = np.unique(shard[tree])
    number = np.full(shard.max() + 1, -1)
    number[held] = np.arange(len(held))
    asks = asks[number[shard[asks]] >= 0]
    forest = Forest(number[shard[tree]], s1[tree], s2[tree])
    for s in range(0, len(asks), 8_192):
        q = asks[s : s + 8_192]
        for a, b, d in forest.search(number[shard[q]], s1[q], s2[q], _radius(n[q], n[q], up, down)):
            a, b = q[a], tree[b]
            keep = (d <= _radius(n[a], n[b], up, down)) & ((n[a] > n[b]) | (n[a] == n[b]) & (c1[a] > c1[b])) & (n[b] * down >= n[a] * up)
            keep &= np.minimum(n[a] - place[a], n[b] - place[b]) * (up + down) >= (n[a] + n[b]) * up
            a, b = a[keep], b[keep]
            if len(a):
                yield np.minimum(c1[a], c1[b]), np.maximum(c1[a], c1[b])


_PAIR = "left long, right long"


def candidates(classes: DataFrame, floor: tuple[int, int]) -> DataFrame:
    """Distinct class pairs (left, right) that some shard's BK-tree finds."""
    up, down = floor
    shared = ship(classes.sparkSession).broadcast(slot_counts(classes))
    sizes, entries_df = large_shards(classes, shared, floor), entries(classes, shared, floor)
    any_large = not sizes.isEmpty()
    rest = entries_df.join(sizes, "token", "left_anti") if any_large else entries_df

    def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(it, "token", 50_000):
            token = part.column("token").to_numpy()
            same = token[1:] == token[:-1]
            met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if met.any():
                yield from _run(part.filter(pa.array(met)))

    def _run(t: pa.Table, cell: bool = False) -> Iterator[pa.RecordBatch]:
        token, c1, n, place, s1, s2 = (t.column(x).to_numpy() for x in ("token", "c1", "n", "place", "s1", "s2"))
        shard = np.cumsum(np.diff(token, prepend=token[0]) != 0)
        both = [(None, None)]
        if cell and t.column("i")[0] != t.column("j")[0]:
            own = t.column("part").to_numpy() == t.column("i")[0].as_py()
            one, two = np.flatnonzero(own), np.flatnonzero(~own)
            both = [(one, two), (two, one)]
        found = [x for tree, asks in both for x in _pairs(shard, c1, n.astype(np.int64), place.astype(np.int64), s1.view(np.uint64), s2.view(np.uint64), up, down, tree, asks)]
        if found:
            left, right = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(left[new]), pa.array(right[new])], names=["left", "right"])

    found = rest.repartition("token").sortWithinPartitions("token").mapInArrow(batch, _PAIR)
    if any_large:
        # part i's tree is searched by part j for i <= j; each pair of parts is a task's work
        cut = entries_df.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int"))
        spread = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        spread = spread.select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "token", "c1", "n", "place", "s1", "s2", "part").withColumn("cell", F.xxhash64("token", "i", "j"))

        def cell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in grouped(it, "cell"):
                yield from _run(part, cell=True)

        found = found.unionByName(spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell, _PAIR))
    return found.distinct()


def enough_shared(pairs: DataFrame, up: int, down: int) -> DataFrame:
    """(left, right, shared, n_left, n_right) of those (left, n_left, h_left, right, n_right,
    h_right) that share enough words; h is in order."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.cumsum(batch.column("n_left").to_numpy().astype(np.int64) + batch.column("n_right").to_numpy())
            starts = np.flatnonzero(np.diff(words // 1_000_000, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                yield few(batch.slice(start, end - start))

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for side in ("h_left", "h_right"):
            h, row = _flat(batch.column(side))
            key = row << 32 | (h.astype(np.int64) + 2**31)
            keys.append(key[np.diff(key, prepend=-1) != 0])
        key = np.sort(np.concatenate(keys), kind="stable")
        shared = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=batch.num_rows)
        n_left, n_right = (batch.column(x).to_numpy().astype(np.int64) for x in ("n_left", "n_right"))
        columns = [batch.column("left"), batch.column("right"), pa.array(shared.astype(np.int32)), batch.column("n_left"), batch.column("n_right")]
        return pa.RecordBatch.from_arrays(columns, names=["left", "right", "shared", "n_left", "n_right"]).filter(pa.array(shared * (up + down) >= (n_left + n_right) * up))

    return pairs.select("left", "n_left", "h_left", "right", "n_right", "h_right").mapInArrow(check, "left long, right long, shared int, n_left int, n_right int")


def similar_pairs(rows: DataFrame, least: dict[str, int], floor: tuple[int, int] = (7, 10)) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): key to class, and the class pairs whose sets are similar enough.

    ``floor`` is the Jaccard similarity as a fraction. Null texts and null keys
    and texts with fewer distinct words than their field's ``least`` stay out.
    Texts with equal word sets, copies above all, are one class (members: field_name,
    key, c1); pairs hold (left, right, shared, n_left, n_right) once for each two
    classes. Long texts are taken whole. An empty table gives no rows.
    """
    up, down = floor
    sets = stage(word_sets(rows, least), "texts")
    members = stage_parts([sets.select("field_name", "key", "c1").distinct()], "members")
    classes = stage_parts([sets.groupBy("c1").agg(F.first("n").alias("n"), F.first("h").alias("h"))], "word-sets")
    drop(sets)
    found = stage_parts([candidates(classes, floor)], "candidates")
    side = lambda name: classes.select(F.col("c1").alias(name), F.col("n").alias(f"n_{name}"), F.col("h").alias(f"h_{name}"))
    pairs = enough_shared(found.join(side("left"), "left").join(side("right"), "right"), up, down)
    return members, pairs


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field_name, left_key, right_key): class pairs and classes of several keys, by key."""
    one = members.select("field_name", F.col("key").alias("a"), F.col("c1").alias("left"))
    two = members.select(F.col("key").alias("b"), F.col("c1").alias("right"))
    across = pairs.select("left", "right").join(one, "left").join(two, "right")
    within = one.join(two, F.col("left") == F.col("right")).where("a < b")
    shape = lambda df: df.select("field_name", F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"))
    return shape(across).unionByName(shape(within))
