"""MiniRocket, from the published paper: 84 fixed kernels of nine taps with weights -1 and
2 (three of them), log-spaced dilations, biases from quantiles of training
convolutions, and the proportion of positive values as the only pooling.

Fitting draws one training series for each kernel and dilation, in the order of a digest
of their keys (again from the first where there are fewer), so what the driver collects is
bounded by the kernels, at most 84 * 32 series.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.operators.families import dilated, matrix, responses
from wavecrest.operators.fourspace import over_series

TAPS = 9
TRIPLES = np.array(list(combinations(range(TAPS), 3)))
#: Series whose responses are held at a time, so that they stay in cache.
CHUNK = 16


def kernels() -> np.ndarray:
    """(84, 9)"""
    w = np.full((len(TRIPLES), TAPS), -1.0)
    np.put_along_axis(w, TRIPLES, 2.0, axis=1)
    return w


def dilations_for(length: int, per_kernel: int, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Dilations and how many features each kernel has at each."""
    count = min(per_kernel, most)
    top = np.log2(max(1.0, (length - 1) / (TAPS - 1)))
    made, share = np.unique(np.logspace(0, top, count, base=2).astype(int), return_counts=True)
    share = (share * (per_kernel / count)).astype(int)
    share[: per_kernel - share.sum()] += 1
    return made, share


def golden(count: int) -> np.ndarray:
    """A low-discrepancy sequence of quantile levels."""
    return (np.arange(1, count + 1) * ((np.sqrt(5) + 1) / 2)) % 1


@dataclass
class MiniRocket:
    dilations: np.ndarray
    share: np.ndarray
    biases: list[np.ndarray]  # for each dilation (84, features)

    @property
    def width(self) -> int:
        return int(len(TRIPLES) * self.share.sum())

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._some(x[k : k + CHUNK]) for k in range(0, len(x), CHUNK)]) if len(x) else np.empty((0, self.width))

    def _some(self, x: np.ndarray) -> np.ndarray:
        out, w, length = [], kernels(), x.shape[1]
        for number, (d, bias) in enumerate(zip(self.dilations, self.biases, strict=True)):
            r, pad = responses(x, w, int(d)), int(d) * (TAPS // 2)
            inner = slice(pad, length - pad) if 2 * pad < length else slice(None)
            made = np.empty((len(w), bias.shape[1], len(x)))
            # kernels take turns between all positions and those whose taps all lie inside
            for first, span in ((number % 2, slice(None)), (1 - number % 2, inner)):
                part = r[first::2, :, span]
                for k in range(bias.shape[1]):
                    made[first::2, k] = np.count_nonzero(part > bias[first::2, k, None, None], axis=2) / part.shape[2]
            out.append(made.reshape(-1, len(x)).T)
        return np.concatenate(out, axis=1)


def fit_arrays(x: np.ndarray, features: int = 1512) -> MiniRocket:
    w = kernels()
    dilations, share = dilations_for(x.shape[1], max(1, features // len(w)))
    level, at, biases = golden(len(w) * int(share.sum())), 0, []
    for number, (d, n) in enumerate(zip(dilations, share, strict=True)):
        bias = np.empty((len(w), n))
        pick = (np.arange(len(w)) + len(w) * number) % len(x)
        r = dilated(x[pick], w, int(d))[np.arange(len(w)), :, np.arange(len(w))]
        for k in range(len(w)):
            bias[k] = np.quantile(r[k], level[at : at + n])
            at += n
        biases.append(bias)
    return MiniRocket(dilations, share, biases)


def fit(series: DataFrame, features: int = 1512, column: str = "x", key: str = "series_id") -> MiniRocket:
    known = series.where(F.size(column) > 0)
    length = known.select(F.size(column)).first()
    if length is None:
        raise ValueError("there are no series to fit on")
    needed = len(TRIPLES) * len(dilations_for(length[0], max(1, features // len(TRIPLES)))[0])
    rows = known.orderBy(F.md5(F.col(key).cast("string")), key).limit(needed).select(F.col(column).cast("array<double>").alias(column)).toArrow()
    return fit_arrays(matrix(rows.column(0).combine_chunks()), features)


def apply(series: DataFrame, model: MiniRocket, column: str = "x", keep: tuple[str, ...] = ("series_id",)) -> DataFrame:
    sent = series.sparkSession.sparkContext.broadcast(model)
    return over_series(series, lambda x: np.nan_to_num(sent.value.features(x)), column, keep, rows=64)


def ppv_at_zero(series: DataFrame, dilations: tuple[int, ...] = (1, 2), column: str = "x", keep: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The untrained core: share of positive responses over all positions, for fixed dilations and no bias."""
    w = kernels()
    return over_series(series, lambda x: np.concatenate([(dilated(x, w, d) > 0).mean(1) for d in dilations], axis=1), column, keep)
