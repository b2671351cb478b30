"""Online sessions: a session grows while cluster, label and status stay the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.operators.islands import islands
from chronolens.sources.shipping import ship

#: Sessions are those of one app on one device.
KEYS = ["device_name", "app"]
_ROW = ["session", "what", "start_us", "end_us", "n"]
_OUT = "device_name string, app string, session long, what string, start_us long, end_us long, n long"
_STATE = "session long, what string, start_us long, end_us long, n long"


def kind_of() -> F.Column:
    """Cluster, label and status as one value to compare."""
    return F.concat_ws("|", F.coalesce(F.col("cluster_id").cast("string"), F.lit("-")), F.coalesce("label", F.lit("-")), F.coalesce("status", F.lit("-")))


def runs(us: np.ndarray, what: np.ndarray) -> list[tuple[int, int, str, int]]:
    """(start, end, what, n) of the stretches of one value among moments in order."""
    edges = np.concatenate([[0], np.flatnonzero(what[1:] != what[:-1]) + 1, [len(what)]])
    return [(int(us[a]), int(us[b - 1]), what[a], int(b - a)) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def extend(state: tuple | None, stretches: list[tuple[int, int, str, int]]) -> tuple[list[list], tuple | None]:
    """(sessions touched, state) after stretches in order; what comes late opens a session."""
    touched: list[list] = []
    held = list(state) if state else None
    for start, end, what, n in stretches:
        if held and held[1] == what and start >= held[3]:
            held[3], held[4] = end, held[4] + n
            if touched:
                touched[-1] = list(held)
            else:
                touched.append(list(held))
        else:
            held = [held[0] + 1 if held else 0, what, start, end, n]
            touched.append(list(held))
    return touched, tuple(held) if held else None


def online_sessions(rows: DataFrame) -> DataFrame:
    """Updates (KEYS, session, what, start_us, end_us, n) from a stream of (KEYS, us, what).

    State is one session for each device and app, so it is as large as there are
    such pairs and nothing has to be dropped from it. Rows of a micro-batch are put
    in time order; across batches, arrival is the order. The last update of a
    session holds. Rows without an app or a moment are left out; a null device is
    a key of its own.
    """
    ship(rows.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(parts)).sort_values(["us", "what"])
        touched, held = extend(state.get if state.exists else None, runs(batch["us"].to_numpy(), batch["what"].to_numpy()))
        if held:
            state.update(held)
        out = pd.DataFrame(touched, columns=_ROW)
        out.insert(0, "app", key[1])
        out.insert(0, "device_name", pd.Series([key[0]] * len(out), dtype=object))
        yield out

    return rows.where("app IS NOT NULL AND us IS NOT NULL").select(*KEYS, "us", "what").groupBy(*KEYS).applyInPandasWithState(update, _OUT, _STATE, "append", "NoTimeout")


def offline_sessions(rows: DataFrame) -> DataFrame:
    """The batch twin over (KEYS, us, what): runs of one value in time order, ended by their own last row."""
    return islands(rows.where("app IS NOT NULL"), KEYS, "what", "what").select(*KEYS, "what", "start_us", "end_us", "n")
