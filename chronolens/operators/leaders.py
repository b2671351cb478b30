"""Leader clustering of a stream of vectors, and sequences of an app or device and day."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.sources.shipping import ship


class Leaders:
    """Running means of clusters in order of their first vector; arrays grow in steps."""

    def __init__(self, threshold: float):
        self.threshold, self.n = threshold, 0
        self.sums = self.units = np.zeros((0, 0))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Cluster number of each vector in order: the best running mean that is similar
        enough, else a new one. Zero vectors always start their own."""
        out = np.empty(len(vectors), np.int64)
        for i, v in enumerate(vectors):
            norm = np.linalg.norm(v)
            best = -1
            if norm and self.n:
                sims = self.units[: self.n] @ (v / norm)
                top = int(np.argmax(sims))
                best = top if sims[top] >= self.threshold else -1
            if best < 0:
                best, self.n = self.n, self.n + 1
                if best == len(self.sums):
                    more = np.zeros((max(16, best), len(v)))
                    self.sums, self.units = (np.concatenate([a.reshape(-1, len(v)), more]) for a in (self.sums, self.units))
                self.sums[best], self.units[best] = v, v / norm if norm else v
            else:
                self.sums[best] += v
                self.units[best] = self.sums[best] / max(np.linalg.norm(self.sums[best]), 1e-12)
            out[i] = best
        return out


def assign_leaders(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of ``vectors`` from an empty state."""
    return Leaders(threshold).assign(vectors)


def leader_clusters(rows: DataFrame, threshold: float = 0.82, keys: tuple[str, ...] = ("app",)) -> DataFrame:
    """(keys, day, key, leader_no) from a stream of (keys, day, us, key, vector); clusters outlast days.

    State is the running means of a key. Rows of a micro-batch are put in order,
    ties in time by key; across batches, arrival is the order. Nulls in vector are left out.
    """
    ship(rows.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else Leaders(threshold)
        pdf = pd.concat(list(parts)).sort_values(["us", "key"])
        numbers = held.assign(np.stack(pdf["vector"].to_numpy()).astype(float))
        state.update((pickle.dumps(held),))
        yield pdf.assign(leader_no=numbers)[[*keys, "day", "key", "leader_no"]]

    clean = rows.where("vector IS NOT NULL").select(*keys, "day", "us", "key", "vector")
    return clean.groupBy(*keys).applyInPandasWithState(update, ", ".join(f"{k} string" for k in keys) + ", day long, key string, leader_no long", "means binary", "append", "NoTimeout")


def last_kept(values: np.ndarray, threshold: float) -> np.ndarray:
    """Which values to keep: the first, then each that differs from the last kept by more than ``threshold``."""
    keep = np.zeros(len(values), bool)
    held = None
    for i, v in enumerate(values):
        if held is None or abs(v - held) > threshold:
            keep[i], held = True, v
    return keep


def changed_rows(rows: DataFrame, keys: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Rows of each key whose value differs from the last kept one; keys hold a bounded span of time."""
    ship(rows.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[last_kept(pdf[value].to_numpy(dtype=float), threshold)]

    clean = rows.where(F.col(value).isNotNull())
    return clean.groupBy(*keys).applyInPandas(one, clean.schema)


def anchor_groups(us: np.ndarray, width_us: int) -> np.ndarray:
    """Group number of sorted moments: a group takes what lies within ``width_us`` of its first."""
    out, no, anchor = np.empty(len(us), np.int64), -1, None
    for i, t in enumerate(us):
        if anchor is None or t - anchor >= width_us:
            no, anchor = no + 1, t
        out[i] = no
    return out


def bursts(rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """(keys, start_us, end_us, n) of groups anchored at their first row; keys hold a bounded span of time."""
    ship(rows.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["us"].to_numpy(dtype=np.int64))
        groups = pd.Series(us).groupby(anchor_groups(us, width_us)).agg(["min", "max", "size"])
        head = {k: [pdf[k].iloc[0]] * len(groups) for k in keys}
        return pd.DataFrame(head | {"start_us": groups["min"].to_numpy(), "end_us": groups["max"].to_numpy(), "n": groups["size"].to_numpy()})

    clean = rows.where("us IS NOT NULL").select(*keys, "us")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clean.schema if f.name in keys)
    return clean.groupBy(*keys).applyInPandas(one, f"{shape}, start_us long, end_us long, n long")


def token_chunks(costs: list[int], starts: list[int], ends: list[int], limit: int, gap_us: int) -> list[int]:
    """Chunk number of each session: a new one where tokens would overflow or a gap is too long."""
    out, no, used = [], -1, 0
    for i, cost in enumerate(costs):
        if no < 0 or used + cost > limit or starts[i] - ends[i - 1] > gap_us:
            no, used = no + 1, 0
        used += cost
        out.append(no)
    return out


def report_chunks(sessions: DataFrame, keys: list[str], limit: int, gap_us: int) -> DataFrame:
    """(keys, chunk_no, start_us, end_us, sessions, tokens) of sessions (keys, start_us, end_us, tokens)."""
    ship(sessions.sparkSession)

    def parts() -> Iterator[str]:
        for f in sessions.schema:
            if f.name in keys:
                yield f"{f.name} {f.dataType.simpleString()}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_us", "end_us", "tokens"])
        pdf = pdf.assign(chunk_no=token_chunks(pdf["tokens"].tolist(), pdf["start_us"].tolist(), pdf["end_us"].tolist(), limit, gap_us))
        out = pdf.groupby("chunk_no").agg(start_us=("start_us", "min"), end_us=("end_us", "max"), sessions=("tokens", "size"), tokens=("tokens", "sum")).reset_index()
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "chunk_no", "start_us", "end_us", "sessions", "tokens"]]

    return sessions.groupBy(*keys).applyInPandas(one, ", ".join(parts()) + ", chunk_no long, start_us long, end_us long, sessions long, tokens long")
