"""Containers of fixed capacity: hierarchical residual packing.

Documents are measured in tokens, cut only where they exceed the capacity, and
spread over groups of bounded size. Each group is packed best fit, largest
first; bins that are nearly full are final, underfull bins go on as items of a
merge tree: FAN_IN groups meet in one, round after round, until one group is
left. Best fit leaves a group one bin at most that is no more than half full
(two would share a bin), so FAN_IN such bins at most ask for room in a merged
group, and of the bins with equal room only so many have to go up as can be
asked in all rounds to come; the others are final without any loss. Every task
therefore holds a bounded number of bins, whatever the sizes of the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.arrow_groups import grouped
from chronolens.sources.shipping import ship
from chronolens.sources.staging import stage

#: Tokens a container holds; items a group holds; fill from which a bin is final; groups that meet.
CAPACITY, GROUP_ITEMS, NEARLY_FULL, FAN_IN = 2_048, 20_000, 0.995, 8
#: Fixed value: the public pattern that splits text before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) by the byte-level BPE ranks in the file ``vocabulary``.

    The driver reads the file and hands it to the tasks. Null texts have 0 tokens;
    strings of special tokens count as ordinary text.
    """
    with open(vocabulary, "rb") as f:
        shared = ship(documents.sparkSession).broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that takes it.

    ``open_`` has bit r set while some bin has r left, so the tightest bin is the
    lowest set bit from the item's size on.
    """
    left: dict[int, list[int]] = {}
    open_, bins = 0, 0
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        above = open_ >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        rest = room - size
        if rest:
            left.setdefault(rest, []).append(b)
            open_ |= 1 << rest
        out[i] = b
    return out


def _going_up(fill: np.ndarray, capacity: int, rounds: int) -> np.ndarray:
    """Which bins take part in the ``rounds`` to come: underfull ones, and of those over half
    full that leave equal room as many as may be asked for it."""
    up = fill < NEARLY_FULL * capacity
    order = np.argsort(fill, kind="stable")
    place = np.empty(len(fill), np.int64)
    place[order] = np.arange(len(fill)) - np.searchsorted(fill[order], fill[order])
    return up & ((2 * fill <= capacity) | (place < FAN_IN * rounds)) if rounds else np.zeros(len(fill), bool)


_GROUP = "cell long, item string, bin string, fill long, up boolean"


def _grouped_fit(items: DataFrame, capacity: int, rounds: int, first: bool) -> DataFrame:
    """(cell, item, bin, fill, up) for every item (cell, item, size): bins of the first round
    have names of their own, later a bin keeps the name of the largest that it is made of."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, "cell"):
            cell = cell.sort_by([("size", "descending"), ("item", "ascending")])  # the same bins, in whatever order rows arrive
            sizes, names = cell.column("size").to_numpy(), cell.column("item").combine_chunks()
            place = best_fit(sizes, capacity)
            fill = np.bincount(place, sizes).astype(np.int64)
            number = cell.column("cell")[0].as_py()
            _, largest = np.unique(place, return_index=True)
            bins = pa.array([f"c{number}-{b}" for b in range(len(fill))]) if first else names.take(pa.array(largest))
            up = _going_up(fill, capacity, rounds)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), number)), names, bins.take(pa.array(place)), pa.array(fill[place]), pa.array(up[place])], names=["cell", "item", "bin", "fill", "up"])

    return items.repartition("cell").sortWithinPartitions("cell").mapInArrow(pack, _GROUP)


def pack(sized: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, doc_id, piece, first_token, n_tokens) for every piece of every document.

    ``sized`` has (doc_id, n_tokens), one row for each document (repeated rows
    count once). A document longer than ``capacity`` is cut into full containers
    of its own and a rest that is packed like any other. Documents without tokens
    have one row with a null container; null ids are left out. Nothing is dropped:
    each document's pieces add up to its tokens. Ties are settled by name, so the
    same input gives the same containers. An empty table gives no rows.
    """
    ship(sized.sparkSession)
    docs = sized.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("n"))
    cut = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1))).alias("piece"))
    first = F.col("piece") * capacity
    pieces = stage(cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n") - first).alias("n_tokens"), F.concat_ws("-", "doc_id", "piece").alias("item")), "pieces")
    whole = pieces.where(F.col("n_tokens") == capacity).withColumn("bin", F.concat(F.lit("w-"), "item"))
    rest = pieces.where((F.col("n_tokens") < capacity) & (F.col("n_tokens") > 0))
    groups = max(1, -(-rest.count() // group_items))
    rounds = 0
    while FAN_IN**rounds < groups:
        rounds += 1
    packed = stage(_grouped_fit(rest.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("cell"), "item", F.col("n_tokens").alias("size")), capacity, rounds, True), "packed")
    homes = packed.select("item", "bin")
    bins = packed.where("up").groupBy("cell", F.col("bin").alias("item")).agg(F.max("fill").alias("size"))
    while rounds:
        rounds -= 1
        merged = stage(_grouped_fit(bins.withColumn("cell", F.floor(F.col("cell") / FAN_IN)), capacity, rounds, False), f"merged-{rounds}")
        moved = merged.where("item <> bin").select(F.col("item").alias("bin"), F.col("bin").alias("to"))
        homes = homes.join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"))
        bins = merged.where("up AND item = bin").select("cell", "item", F.col("fill").alias("size"))
    placed = pieces.join(homes, "item")
    empty = pieces.where(F.col("n_tokens") == 0).withColumn("bin", F.lit(None).cast("string"))
    shape = lambda df: df.select(F.col("bin").alias("container"), "doc_id", "piece", "first_token", "n_tokens")
    return shape(placed).unionByName(shape(whole)).unionByName(shape(empty))
