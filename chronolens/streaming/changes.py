"""Which captures of a window or monitor to store: those that differ from the last stored one."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronolens.functions.images import change
from chronolens.sources.shipping import ship

#: Fixed value: change from which a capture is stored.
THRESHOLD = 0.006
_OUT = "key string, us long, id string, change double, most double"


def keep_changes(state: tuple | None, rows: list[tuple[int, str, np.ndarray]], threshold: float = THRESHOLD) -> tuple[list[list], tuple | None]:
    """(stored rows, state) of captures in order; the first is always stored. ``most`` is
    the largest change seen since the row before it was stored."""
    out, held, most = [], *(state or (None, 0.0))
    for us, id_, pixels in rows:
        score = 1.0 if held is None else change(held, pixels)
        most = max(most, score)
        if held is None or score >= threshold:
            out.append([us, id_, score, most])
            held, most = pixels, 0.0
    return out, None if held is None else (held, most)


def _ordered(pdf: pd.DataFrame) -> list[tuple[int, str, np.ndarray]]:
    rows = pdf.dropna(subset=["pixels"]).sort_values(["us", "id"])
    return [(int(u), i, np.asarray(p)) for u, i, p in rows[["us", "id", "pixels"]].itertuples(index=False)]


def stored_batch(captures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Batch twin over (key, us, id, pixels array<int>); keys hold a bounded span of time."""
    ship(captures.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = keep_changes(None, _ordered(pdf), threshold)
        return pd.DataFrame([[pdf["key"].iloc[0], *r] for r in out], columns=["key", "us", "id", "change", "most"])

    return captures.groupBy("key").applyInPandas(one, _OUT)


def stored_stream(captures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same on a stream; state is the last stored picture of each key."""
    ship(captures.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, held = keep_changes(pickle.loads(state.get[0]) if state.exists else None, _ordered(pd.concat(list(parts))), threshold)
        if held is not None:
            state.update((pickle.dumps(held),))
        yield pd.DataFrame([[key[0], *r] for r in out], columns=["key", "us", "id", "change", "most"])

    return captures.groupBy("key").applyInPandasWithState(update, _OUT, "held binary", "append", "NoTimeout")
