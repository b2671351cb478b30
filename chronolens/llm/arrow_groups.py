"""Groups that lie side by side in a sorted partition, as Arrow tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal ``key`` values; the partition is sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(edges[:-1], edges[1:]):
            if held and keys[start] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def blocks(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, as few as hold ``rows`` rows or more; for many small groups."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1])
        if len(edges):
            end = int(edges[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, end)])
            held = [batch.slice(end)]
            count = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` floats, as an (n, dim) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)
