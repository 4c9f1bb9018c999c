"""Window features of event streams.

Each key keeps its last 64 values; every 16 arrivals that follow the first 64 give a
window, so a stream's windows are those that `prep.windows` cuts inside a series. Two
things differ from the batch form and make the results not interchangeable: values
are normalised within their window, as a stream has no end to take a mean up to, and
the last window that ends with the series doesn't exist.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavecrest.operators.families import SIZE, WIDTHS, phi
from wavecrest.operators.prep import HOP

STATE = "held array<double>, arrived long"


def stream_features(events: DataFrame, key: str, order: Sequence[str], value: str, names: Sequence[str] = tuple(WIDTHS), normalise: bool = True) -> DataFrame:
    """(key, w, values) of a streaming frame: the w-th window of each key as soon as its last value arrives.

    Values of one micro-batch are taken in the given order; null values count as 0.
    """
    names, order = list(names), list(order)
    kind = events.schema[key].dataType.simpleString()

    def work(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, arrived = state.get if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        values = np.concatenate([np.asarray(held, float), np.nan_to_num(rows["v"].to_numpy(float))])
        first = arrived - len(held)  # number of the oldest value that is held
        arrived += len(rows)
        ends = np.arange(max(SIZE, -(-(arrived - len(rows) + 1 - SIZE) // HOP) * HOP + SIZE), arrived + 1, HOP)
        if len(ends):
            cut = values[(ends - SIZE - first)[:, None] + np.arange(SIZE)]
            if normalise:
                cut = (cut - cut.mean(1, keepdims=True)) / (cut.std(1, keepdims=True) + 1e-8)
            yield pd.DataFrame({key: [keys[0]] * len(ends), "w": (ends - SIZE) // HOP, "values": list(phi(cut, names))})
        state.update((values[-(SIZE - 1) :].tolist(), arrived))

    rows = events.select(key, *order, F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, w long, values array<double>", STATE, "append", GroupStateTimeout.NoTimeout)
