"""Balanced posting lists over vectors.

Lists grow in number with the rows, about one for ROWS_A_LIST. Centroids are
fitted on bounded samples; every row is indexed. The centroids of one node, at
most FAN_OUT, are searched by a graph in memory: a walk from hubs along edges to
near centroids. A vector goes to its nearest centroid's list and, near a
boundary, to each further list that the walk holds whose distance is within a
ratio of the nearest one. Where one node's centroids are too few for the rows,
its lists are coarse: each is fitted fine centroids of its own, a vector looks
into its nearest coarse lists and goes to fine lists by the same rule, whichever
coarse list they are of, so it is in no more lists than with one node. Fine
centroids are broadcast in packs, of which a task opens one at a time, so
nothing that is held by a task grows with the data. A list that its sample shows
to be beyond LIST_BOUND is cut into parts, and every two parts meet in a cell of
their own. Equal vectors travel as one entry with their smallest keys, so a group
of copies, however large, is one row of a list.

Each vector is written once, with the cells it belongs to. Cells are searched in
passes: a pass moves the entries of its own cells only, and what it moved is
given up before the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolens.llm.arrow_groups import grouped, matrix
from chronolens.sources.shipping import ship
from chronolens.sources.staging import drop, stage, stage_parts

#: Rows that the centroids of a node are fitted on, at most about so many.
SAMPLE_ROWS = 32_768
#: Rows for one list; lists of one node (2 MB of centroids); entries in a part of a list.
ROWS_A_LIST, FAN_OUT, LIST_BOUND = 96, 8_192, 2_048
#: Rows whose entries are a partition's, some 14 MB, however many there are; rows that meet
#: fine centroids at once.
ROWS_A_PARTITION, ROWS_A_TASK = 12_000, 50_000
#: Passes over the cells, fewer where rows are few; coarse lists that a row looks into, and so few of
#: them that all are looked at; fine centroids in a pack (16 MB); rows that a fine centroid is fitted on.
PASSES, ROWS_A_PASS, COARSE, COARSE_EXACT, PACK, FINE_ROWS = 4, 50_000, 32, 1_024, 65_536, 16
#: Near centroids that a centroid has edges to; pivots that a walk starts from and their
#: centroids at most; centroids that a walk holds, and follows at least; so few that no graph is needed.
DEGREE, PIVOTS, STARTS, WIDTH, LEAST, EXACT = 16, 24, 24, 16, 3, 256


def usable(vector: Column, dim: int) -> Column:
    """Not null, ``dim`` long, every number finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hashed(df: DataFrame) -> DataFrame:
    """``df`` with k1 and k2, 128 bits that stand for the vector's exact value."""
    return df.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(7), "vector")})


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def fit_centroids(points: np.ndarray, n_lists: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means that moves empty or tiny lists into the fullest ones."""
    rng = np.random.default_rng(11)
    n_lists = max(1, min(n_lists, len(points)))
    centres = points[rng.permutation(len(points))[:n_lists]].copy()
    for turn in range(rounds):
        near = np.concatenate([np.argmax(points[s : s + 4096] @ centres.T, axis=1) for s in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=n_lists)
        centres = np.where(counts[:, None] > 0, sums, centres)
        centres = unit(centres).astype(np.float32)
        if turn < rounds - 1:
            full = np.flatnonzero(counts > 3 * len(points) / n_lists)
            spare = np.argsort(counts)[: len(full)]
            for a, b in zip(full, spare):
                if counts[b] < counts[a] / 3:
                    centres[b] = points[rng.choice(np.flatnonzero(near == a))]
    return centres


class CentroidGraph:
    """Centroids joined to their nearest ones, walked by many vectors at once.

    Pivots, each the mean of some STARTS centroids at most, say where a walk starts:
    every centroid is a start of some pivot, so none is out of reach.
    """

    def __init__(self, centres: np.ndarray, degree: int = DEGREE, exact: int = EXACT):
        self.centres, self.n = np.ascontiguousarray(centres, np.float32), len(centres)
        self.norms = (self.centres**2).sum(1)
        self.flat = self.n <= exact  # so few that all of them are looked at
        if self.flat:
            return
        near, far = np.empty((self.n, degree), np.int64), np.empty((self.n, degree), np.float32)
        for s in range(0, self.n, 1024):
            d = self.norms[None, :] - 2 * self.centres[s : s + 1024] @ self.centres.T
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near[s : s + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            far[s : s + 1024] = np.take_along_axis(d, near[s : s + 1024], 1)
        # edges back: what holds a centroid as its own near one is near it too; a row's spare places hold the centroid itself
        to, back = near.reshape(-1), np.repeat(np.arange(self.n), degree)
        order = np.lexsort(((far + self.norms[:, None]).reshape(-1), to))
        to, back = to[order], back[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        first = place < degree // 2
        more = np.repeat(np.arange(self.n)[:, None], degree // 2, axis=1)
        more[to[first], place[first]] = back[first]
        more[(more[:, :, None] == near[:, None, :]).any(2)] = 0
        more = np.where(more == 0, np.arange(self.n)[:, None], more)
        self.edges = np.concatenate([near, more], axis=1)
        pivots = fit_centroids(unit(self.centres), max(2, int(2 * self.n**0.5)))
        of = np.argmax(unit(self.centres) @ pivots.T, axis=1)
        order = np.argsort(of, kind="stable")
        place = np.arange(self.n) - np.searchsorted(of[order], of[order])
        group = np.cumsum((place % STARTS == 0).astype(np.int64)) - 1
        self.starts = np.full((group[-1] + 1, STARTS), -1)
        self.starts[group, place % STARTS] = order
        filled = self.starts >= 0
        self.pivots = (np.where(filled[:, :, None], self.centres[self.starts], 0).sum(1) / filled.sum(1, keepdims=True)).astype(np.float32)
        self.pivot_norms = (self.pivots**2).sum(1)

    def walk(self, x: np.ndarray, ratio: float, width: int = WIDTH, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid): the centroids that each row's walk found within ``ratio`` of its nearest,
        or within the row's squared distance ``reach``.

        A walk holds its ``width`` nearest centroids so far and follows the edges of
        each of them that is within the ratio, until none is left.
        """
        reach = np.zeros(len(x), np.float32) if reach is None else reach
        return self._blocks(x, ratio, width, reach, False)

    def nearest(self, x: np.ndarray, ratio: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid): all ``width`` nearest centroids that each row's walk holds."""
        return self._blocks(x, ratio, width, np.zeros(len(x), np.float32), True)

    def _blocks(self, x: np.ndarray, ratio: float, width: int, reach: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        width = min(width, self.n)
        out = [self._block(x[s : s + 1024], ratio * ratio, width, reach[s : s + 1024, None], every) for s in range(0, len(x), 1024)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r + 1024 * i for i, (r, _) in enumerate(out)]), np.concatenate([c for _, c in out])

    def _block(self, x: np.ndarray, limit: float, width: int, reach: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        own = (x**2).sum(1, keepdims=True)
        if self.flat:
            dist = np.maximum(own + self.norms[None, :] - 2 * x @ self.centres.T, 1e-12)
            held = np.broadcast_to(np.arange(self.n), dist.shape)
            if width < self.n:
                held = np.argpartition(dist, width - 1, axis=1)[:, :width]
                dist = np.take_along_axis(dist, held, 1)
        else:
            held, dist = self._walked(x, own, limit, width, reach)
        row, place = np.nonzero(np.isfinite(dist) if every else dist <= np.maximum(limit * dist.min(1, keepdims=True), reach))
        return row, held[row, place]

    def _walked(self, x: np.ndarray, own: np.ndarray, limit: float, width: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(x)
        far = self.pivot_norms[None, :] - 2 * x @ self.pivots.T
        first = np.argpartition(far, min(PIVOTS, far.shape[1]) - 1, axis=1)[:, :PIVOTS]
        held = self.starts[first].reshape(m, -1)
        dist = np.where(held >= 0, self._far(x, own, held), np.inf)
        seen = np.zeros((m, self.n), bool)
        row, place = np.nonzero(held >= 0)
        seen[row, held[row, place]] = True
        kept = np.argpartition(dist, width - 1, axis=1)[:, :width]
        held, dist = np.take_along_axis(held, kept, 1), np.take_along_axis(dist, kept, 1)
        done = np.zeros(held.shape, bool)
        live = np.arange(m)
        while len(live):
            d = dist[live]
            followed = np.maximum(np.maximum(limit * d.min(1, keepdims=True), reach[live]), np.partition(d, LEAST, axis=1)[:, LEAST : LEAST + 1])
            open_ = np.where(done[live] | (d > followed), np.inf, d)
            at = open_.argmin(1)
            going = np.isfinite(open_[np.arange(len(live)), at])
            live, at = live[going], at[going]
            done[live, at] = True
            near = self.edges[held[live, at]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = np.where(fresh, self._far(x[live], own[live], near), np.inf)
            better = (d < dist[live].max(1, keepdims=True)).any(1)
            now, d, near = live[better], d[better], near[better]
            if len(now):
                every = np.concatenate([dist[now], d], axis=1)
                kept = np.argpartition(every, width - 1, axis=1)[:, :width]
                dist[now] = np.take_along_axis(every, kept, 1)
                held[now] = np.take_along_axis(np.concatenate([held[now], near], axis=1), kept, 1)
                done[now] = np.take_along_axis(np.concatenate([done[now], np.zeros(near.shape, bool)], axis=1), kept, 1)
        return held, dist

    def _far(self, x: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.maximum(own + self.norms[to] - 2 * np.matmul(self.centres[to], x[:, :, None])[:, :, 0], 1e-12)


@dataclass
class ListIndex:
    """One node: its centroids, the optional projection they live in, the boundary ratio
    and into how many parts each list is cut."""

    dim: int
    centres: np.ndarray
    projection: np.ndarray | None
    ratio: float
    parts: np.ndarray | None = None
    reach: float = 0.0
    exact: int = EXACT
    graph: CentroidGraph = field(init=False)

    def __post_init__(self):
        self.graph = CentroidGraph(self.centres, exact=self.exact)

    def seen(self, units: np.ndarray) -> np.ndarray:
        """The vectors in the space of the centroids."""
        return units if self.projection is None else units @ self.projection

    def lists_of(self, units: np.ndarray, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the nearest list and each further one within the ratio; what only ``asks``
        and is no candidate also looks into lists whose centroid is similar enough itself."""
        reach = None if asks is None else np.where(asks, np.float32(self.reach), np.float32(0))
        return self.graph.walk(self.seen(units), self.ratio, reach=reach)

    def fine_of(self, units: np.ndarray, asks: np.ndarray, packs: Iterator[FineLists]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, fine list, its parts), by the rule of ``lists_of``: of all fine lists of a row's COARSE
        nearest lists, the nearest and each of the WIDTH nearest that is within the ratio of it."""
        x = self.seen(units)
        limit, reach = self.ratio * self.ratio, np.where(asks, np.float32(self.reach), np.float32(0))
        row, coarse = self.graph.nearest(x, self.ratio, COARSE)
        order = np.argsort(coarse, kind="stable")
        row, coarse = row[order], coarse[order]
        own, best = (x**2).sum(1), np.full(len(x), np.inf, np.float32)
        found = []
        for pack in packs:
            low, high = np.searchsorted(coarse, pack.of), np.searchsorted(coarse, pack.of, "right")
            for i in np.flatnonzero(high > low):
                r, a, b = row[low[i] : high[i]], pack.starts[i], pack.starts[i + 1]
                d = np.maximum(own[r, None] + pack.norms[a:b] - 2 * x[r] @ pack.centres[a:b].T, 1e-12)
                best[r] = np.minimum(best[r], d.min(1))
                at, to = np.nonzero(d <= np.maximum(limit * best[r], reach[r])[:, None])
                found.append((r[at], pack.base + a + to, d[at, to], pack.parts[a + to]))
        row, to, far, parts = (np.concatenate(c) for c in zip(*found))
        kept = far <= np.maximum(limit * best[row], reach[row])
        row, to, far, parts = row[kept], to[kept], far[kept], parts[kept]
        order = np.lexsort((far, row))
        row, to, parts = row[order], to[order], parts[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < WIDTH
        return row[kept], to[kept], parts[kept]

    def cut(self, points: np.ndarray, scale: float, bound: int | None) -> ListIndex:
        """Sets ``parts`` by how many of the sample's ``points``, each standing for ``scale`` rows, a list has."""
        self.parts = np.ones(len(self.centres), np.int64)
        if bound:
            _, to = self.lists_of(points)
            self.parts = np.maximum(1, -(-np.bincount(to, minlength=len(self.centres)) * scale // bound)).astype(np.int64)
        return self


@dataclass
class FineLists:
    """A pack: the fine centroids of the coarse lists ``of``, those of one side by side between its
    two ``starts``; fine lists are numbered on from ``base``."""

    base: int
    of: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    parts: np.ndarray
    norms: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norms = (self.centres**2).sum(1)


def fit_node(points: np.ndarray, n_lists: int, dim: int, ratio: float, projection: np.ndarray | None, scale: float, bound: int | None, reach: float = 0.0) -> ListIndex:
    """The index of one node, fitted on unit vectors that stand for ``scale`` rows each."""
    centres = fit_centroids(points, n_lists) if projection is None else fit_plain(points @ projection, n_lists)
    return ListIndex(dim, centres, projection, ratio, reach=reach).cut(points, scale, bound)


def fit_index(vectors: DataFrame, dim: int, ratio: float, reduced: int | None, fan_out: int, rows_a_list: int, sample_rows: int, bound: int | None, reach: float) -> tuple[int, ListIndex, np.ndarray | None]:
    """(rows, the first node, about how many rows each of its lists has if it is coarse), fitted on about
    ``sample_rows`` rows chosen by a hash of the key; rows only decide where lists lie, every row is
    indexed later. No usable rows: one list."""
    vectors = vectors.where("kind = 0")
    total = vectors.count()
    step = max(1, -(-total // sample_rows))
    sample = vectors.where(F.pmod(F.xxhash64("key", "vector"), F.lit(step)) == 0).select("vector").limit(2 * sample_rows).toArrow()
    points = unit(matrix(sample.column("vector"), dim)) if sample.num_rows else np.eye(1, dim, dtype=np.float32)
    points = np.unique(points, axis=0)
    projection = None
    if reduced and reduced < dim and len(points) > reduced:
        _, axes = np.linalg.eigh(points.T @ points)
        projection = np.ascontiguousarray(axes[:, ::-1][:, :reduced]).astype(np.float32)
    scale = total / max(len(points), 1)
    if total <= 4 * fan_out * rows_a_list:
        return total, fit_node(points, int(np.clip(total // rows_a_list, 1, fan_out)), dim, ratio, projection, scale, bound, reach), None
    # some 16 times as many coarse lists as fine ones in each, so a row meets about twice as many fine ones as coarse ones
    n_lists = int(min(fan_out, max(4 * (total / rows_a_list) ** 0.5, total / rows_a_list / fan_out)))
    centres = fit_centroids(points, n_lists) if projection is None else fit_plain(points @ projection, n_lists)
    index = ListIndex(dim, centres, projection, ratio, reach=reach, exact=COARSE_EXACT)
    _, to = index.graph.nearest(index.seen(points), ratio, 1)
    return total, index, np.maximum(np.bincount(to, minlength=len(centres)), 1) * scale


def fit_plain(points: np.ndarray, n_lists: int) -> np.ndarray:
    """Centroids in a reduced space: assigned by direction, placed at the mean."""
    directions = unit(points)
    centres = fit_centroids(directions, n_lists)
    near = np.concatenate([np.argmax(directions[s : s + 4096] @ centres.T, axis=1) for s in range(0, len(points), 4096)])
    sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
    np.add.at(sums, near, points)
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres * np.linalg.norm(points, axis=1).mean()).astype(np.float32)


#: A vector with the cells it belongs to.
PLACED = "kind int, k1 long, k2 long, keys array<string>, vector array<float>, cells array<long>"


def _merge(kind: np.ndarray, k1: np.ndarray, k2: np.ndarray, keys: list[list[str]], kept: int) -> tuple[np.ndarray, list[list[str]]]:
    """Rows of equal vectors become one: (kept rows, their ``kept`` smallest keys). Queries
    that are no candidates (kind 1) are never merged."""
    alone = np.where(kind == 0, 0, np.arange(1, len(kind) + 1))
    _, first, back, count = np.unique(np.stack([alone, k1, k2]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    back = back.reshape(-1)
    merged = [keys[i] for i in first]
    if len(first) < len(k1):
        for g in np.flatnonzero(count > 1):
            merged[g] = sorted({x for i in np.flatnonzero(back == g) for x in keys[i]})[:kept]
    return first, merged


def _vectors(flat: np.ndarray, dim: int) -> pa.ListArray:
    flat = np.ascontiguousarray(flat, np.float32).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))


def _cells(at: np.ndarray, to: np.ndarray, n: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for rows ``at`` in lists ``to`` of ``n`` parts. An entry of a list in parts stands
    in the cell of its part with each other part."""
    if not (n > 1).any():
        return at, to
    again = np.maximum(n - 1, 1)
    other = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    at, to, n = np.repeat(at, again), np.repeat(to, again), np.repeat(n, again)
    part = (k1[at].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
    other = other + (other >= part)
    low, high = np.minimum(part, other).astype(np.uint64), np.maximum(part, other).astype(np.uint64)
    mixed = (to.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ low * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) + high * np.uint64(0x9FB21C651E98DF25)
    return at, np.where(n > 1, (mixed ^ mixed >> np.uint64(31)).view(np.int64), to)


def _fine_packs(vectors: DataFrame, index: ListIndex, sizes: np.ndarray, fan_out: int, rows_a_list: int, sample_rows: int, bound: int | None) -> Iterator[FineLists]:
    """Every coarse list's own centroids, one for about ``rows_a_list`` of its ``sizes`` rows, fitted in
    tasks on bounded samples; a list without a sampled row keeps the coarse centroid."""
    dim, ratio, projection = index.dim, index.ratio, index.projection
    n_lists = np.clip(sizes // rows_a_list, 1, fan_out).astype(np.int64)
    share = np.minimum(1.0, np.minimum(sample_rows, n_lists * FINE_ROWS) / sizes)
    turns = 1 << 20
    coarse = ship(vectors.sparkSession).broadcast((index, n_lists, share))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, share = coarse.value
        for batch in batches:
            if not batch.num_rows:
                continue
            k2, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            raw = matrix(batch.column(1), dim)[first]
            row, to = index.graph.nearest(index.seen(unit(raw)), ratio, 1)
            kept = k2[row] % turns < share[to] * turns
            yield pa.RecordBatch.from_arrays([pa.array(to[kept].astype(np.int64)), _vectors(raw[row[kept]], dim)], names=["list", "vector"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n_lists, share = coarse.value
        for t in grouped(batches, "list"):
            c = t.column("list")[0].as_py()
            node = fit_node(np.unique(unit(matrix(t.column("vector"), dim)), axis=0), int(n_lists[c]), dim, ratio, projection, 1 / float(share[c]), bound)
            pack = np.concatenate([node.centres, node.parts[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([t.column("list")[:1].combine_chunks(), _vectors(pack, pack.size)], names=["list", "pack"])

    chosen = vectors.where((F.col("kind") == 0) & (F.pmod("k2", F.lit(turns)) < F.lit(float(share.max() * turns)))).select("k2", "vector")
    packs = stage(chosen.mapInArrow(sample, "list long, vector array<float>").repartition("list").sortWithinPartitions("list").mapInArrow(fit, "list long, pack array<float>"), "centroids")
    width = index.centres.shape[1] + 1
    counts = np.ones(len(index.centres), np.int64)
    for r in packs.select("list", F.size("pack").alias("n")).collect():
        counts[r["list"]] = r["n"] // width
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = int(ends[start] - counts[start])
        end = max(start + 1, int(np.searchsorted(ends, base + PACK, "right")))
        own = packs.where((F.col("list") >= start) & (F.col("list") < end)).toArrow()
        held = {c: np.asarray(v.values, np.float32).reshape(-1, width) for c, v in zip(own.column("list").to_pylist(), own.column("pack"))}
        whole = np.concatenate([held[c] if c in held else np.append(index.centres[c], np.float32(1))[None, :] for c in range(start, end)])
        yield FineLists(base, np.arange(start, end), np.append(ends[start:end] - counts[start:end], ends[end - 1]) - base, np.ascontiguousarray(whole[:, :-1]), whole[:, -1].astype(np.int64))
        start = end


def _opened(packs: list[Broadcast]) -> Iterator[FineLists]:
    """One pack after another; of several, a worker holds one at a time."""
    for pack in packs:
        yield pack.value
        if len(packs) > 1:
            vars(pack).pop("_value", None)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def in_lists(
    vectors: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, label: str,
    dim: int, ratio: float, kept: int, reduced: int | None = None, fan_out: int = FAN_OUT, rows_a_list: int = ROWS_A_LIST, sample_rows: int = SAMPLE_ROWS, bound: int | None = LIST_BOUND, reach: float = 0.0,
) -> DataFrame:
    """What ``search`` finds in the entries (cell, kind, k1, k2, keys, vector) of every list, sorted by cell
    inside their partition, as a table written to the shared folder; ``kept`` keys for equal vectors.

    ``vectors`` has (key, kind, vector). One node of lists serves up to 4 x ``fan_out`` x
    ``rows_a_list`` rows; beyond that its lists are coarse. ``bound`` None keeps lists
    whole; ``reach`` is the squared distance within which rows of kind 1 look into a list.
    """
    total, index, sizes = fit_index(vectors, dim, ratio, reduced, fan_out, rows_a_list, sample_rows, bound, reach)
    vectors = hashed(vectors).select("key", "kind", "k1", "k2", "vector")
    sc = ship(vectors.sparkSession)
    shared = sc.broadcast(index)
    packs = [] if sizes is None else [sc.broadcast(p) for p in _fine_packs(vectors, index, sizes, fan_out, rows_a_list, sample_rows, bound)]
    at_once = ROWS_A_TASK if packs else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in _blocks(batches, at_once):
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kind, k1, k2 = (column[n].to_numpy() for n in ("kind", "k1", "k2"))
            rows, keys = _merge(kind, k1, k2, [[x] for x in column["key"].to_pylist()], kept)
            kind, k1, k2, raw = kind[rows], k1[rows], k2[rows], matrix(column["vector"], index.dim)[rows]
            units = unit(raw.astype(np.float64)).astype(np.float32)
            if packs:
                at, to, n = index.fine_of(units, kind == 1, _opened(packs))
            else:
                at, to = index.lists_of(units, kind == 1)
                n = index.parts[to]
            at, cell = _cells(at, to, n, k1)
            cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(rows) + 1)).astype(np.int32)), pa.array(cell))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(k1), pa.array(k2), pa.array(keys, pa.list_(pa.string())), _vectors(raw, index.dim), cells], names=["kind", "k1", "k2", "keys", "vector", "cells"])

    placed = stage(vectors.mapInArrow(assign, PLACED), "placed")
    passes = int(np.clip(-(-total // ROWS_A_PASS), 1, PASSES))
    partitions = max(8, -(-total // (ROWS_A_PARTITION * passes)))

    def one(turn: int) -> DataFrame:
        own = F.filter("cells", lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == turn) if passes > 1 else F.col("cells")
        entries = placed.select(F.explode(own).alias("cell"), "kind", "k1", "k2", "keys", "vector")
        return entries.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(search, schema)

    found = stage_parts((one(turn) for turn in range(passes)), label)
    drop(placed)
    return found


@dataclass
class Entries:
    """One list's entries with equal vectors merged."""

    kind: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    keys: list[list[str]]
    units: np.ndarray

    @staticmethod
    def of(table: pa.Table, dim: int, kept: int) -> Entries:
        kind, k1, k2 = (table.column(n).to_numpy() for n in ("kind", "k1", "k2"))
        rows, keys = _merge(kind, k1, k2, table.column("keys").to_pylist(), kept)
        return Entries(kind[rows], k1[rows], k2[rows], keys, unit(matrix(table.column("vector"), dim)[rows].astype(np.float64)))
