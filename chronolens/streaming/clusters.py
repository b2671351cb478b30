"""Online clustering of captures: committed, candidate and pending groups of an app."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.sources.shipping import ship

#: Similarities to join a committed cluster, a candidate or a pending
#: group; to move a committed centroid; blend rates; members to promote; seconds a
#: pending group waits.
COMMITTED, CANDIDATE, PENDING, STRONG = 0.82, 0.78, 0.78, 0.90
BLEND_STRONG, BLEND_FOLLOWER, PROMOTE_AT, WAIT_S = 0.05, 0.02, 3, 1_800
_STATUS = ["pending", "candidate", "committed"]


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm else np.zeros(len(v))


@dataclass
class Group:
    leader: str
    count: int = 1
    label: str | None = None
    status: str = "pending"


@dataclass
class AppClusters:
    """All groups of one app; events come in order. Of its members a group keeps the leader and a count.

    Row i of the arrays belongs to ``groups[i]``: centroid, its unit vector, place in
    ``_STATUS`` and last moment; they are longer than ``groups``, to grow in steps.
    """

    groups: list[Group] = field(default_factory=list)
    waiting: dict[str, int] = field(default_factory=dict)  # pending groups by leader
    centroids: np.ndarray | None = None
    units: np.ndarray | None = None
    stage: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    seen_us: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _best(self, sims: np.ndarray, status: str, least: float, since: int | None = None) -> tuple[int, float] | None:
        n = len(self.groups)
        open_ = self.stage[:n] == _STATUS.index(status)
        if since is not None:
            open_ &= self.seen_us[:n] >= since
        at = np.flatnonzero(open_)
        if not len(at):
            return None
        i = int(at[np.argmax(sims[at])])  # ties: the older group
        return (i, float(sims[i])) if sims[i] >= least else None

    def _move(self, i: int, centroid: np.ndarray) -> None:
        self.centroids[i] = self.units[i] = _unit(centroid)  # blends weigh alike only between unit vectors

    def _turn(self, i: int, status: str) -> None:
        self.groups[i].status, self.stage[i] = status, _STATUS.index(status)

    def _open(self, key: str, us: int, v: np.ndarray) -> int:
        i = len(self.groups)
        if i == len(self.stage):
            more = max(16, i)
            grown = lambda a: np.concatenate([a, np.zeros((more, *a.shape[1:]), a.dtype)])
            if self.centroids is None:
                self.centroids, self.units = np.zeros((0, len(v))), np.zeros((0, len(v)))
            self.centroids, self.units, self.stage, self.seen_us = (grown(a) for a in (self.centroids, self.units, self.stage, self.seen_us))
        self.groups.append(Group(key))
        self.waiting.setdefault(key, i)
        self.seen_us[i] = us
        self._move(i, v)
        self._turn(i, "pending")
        return i

    def capture(self, key: str, us: int, v: np.ndarray) -> tuple[int, str]:
        """(group, status) of a capture: committed, then candidate, then pending, else its own leader."""
        sims = self.units[: len(self.groups)] @ _unit(v) if self.groups else np.zeros(0)
        if found := self._best(sims, "committed", COMMITTED):
            if found[1] >= STRONG:
                self._move(found[0], (1 - BLEND_STRONG) * self.centroids[found[0]] + BLEND_STRONG * _unit(v))
        elif found := self._best(sims, "candidate", CANDIDATE):
            pass
        elif found := self._best(sims, "pending", PENDING, us - WAIT_S * 1_000_000):
            self._move(found[0], (1 - BLEND_FOLLOWER) * self.centroids[found[0]] + BLEND_FOLLOWER * _unit(v))
        else:
            return self._open(key, us, v), "pending"
        i = found[0]
        g = self.groups[i]
        g.count += 1
        self.seen_us[i] = max(self.seen_us[i], us)
        if g.status == "candidate" and g.count >= PROMOTE_AT:
            self._turn(i, "committed")
        return i, g.status

    def name(self, key: str, label: str) -> int | None:
        """A label for the pending group that ``key`` leads: it becomes a candidate. Gives the group."""
        if (i := self.waiting.pop(key, None)) is not None:
            self.groups[i].label = label
            self._turn(i, "committed" if self.groups[i].count >= PROMOTE_AT else "candidate")
        return i


def replay(app: AppClusters, events: pd.DataFrame) -> list[list]:
    """Rows (day, key, kind, group_no, status, label) for events (day, us, kind, key, vector, label):
    one for each capture (kind 0) and one for each group that a label names (kind 1)."""
    out = []
    for day, us, kind, key, vector, label in events.sort_values(["us", "kind", "key"])[["day", "us", "kind", "key", "vector", "label"]].itertuples(index=False):
        if kind == 0:
            number, status = app.capture(key, int(us), np.asarray(vector, float))
            out.append([day, key, 0, number, status, app.groups[number].label])
        elif (number := app.name(key, label)) is not None:
            out.append([day, key, 1, number, app.groups[number].status, label])
    return out


_NAMES = ["day", "key", "kind", "group_no", "status", "label"]
_OUT = "day long, key string, kind int, group_no long, status string, label string"
_KEYS = ("app",)


def _frame(keys: tuple[str, ...], values: tuple, rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame([[*values, *r] for r in rows], columns=[*keys, *_NAMES])


def cluster_days(events: DataFrame, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Batch twin for small tables: all days of each key of (keys, day, us, kind, key, vector, label) in one task.

    kind 0 is a capture, 1 a label for the group that the key leads.
    """
    ship(events.sparkSession)

    def one(values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(keys, values, replay(AppClusters(), pdf))

    return events.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} string" for k in keys) + f", {_OUT}")


def cluster_stream(events: DataFrame, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """The same on a stream; state is the groups of a key, which outlast every day.

    Rows of a micro-batch are put in order; across batches, arrival is the order
    (``ordered_stream`` makes it the order of time and bounds a batch).
    """
    ship(events.sparkSession)

    def update(values: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        app = pickle.loads(state.get[0]) if state.exists else AppClusters()
        rows = replay(app, pd.concat(list(parts)))
        state.update((pickle.dumps(app),))
        yield _frame(keys, values, rows)

    return events.groupBy(*keys).applyInPandasWithState(update, ", ".join(f"{k} string" for k in keys) + f", {_OUT}", "groups binary", "append", "NoTimeout")


def named_followers(rows: DataFrame, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Captures (keys, day, key, group_no, status, label) of a clustering; those that came before
    their group had a name have it too, with the status that the group then took."""
    names = rows.where("kind = 1").select(*keys, "group_no", F.col("label").alias("__label"), F.col("status").alias("__status"))
    same = F.col("a.group_no") == F.col("b.group_no")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    late = F.col("label").isNull() & F.col("__label").isNotNull()
    both = rows.where("kind = 0").alias("a").join(names.alias("b"), same, "left")
    return both.select(*[f"a.{k}" for k in keys], "day", "key", "a.group_no", F.when(late, F.col("__status")).otherwise(F.col("status")).alias("status"), F.coalesce("label", "__label").alias("label"))
