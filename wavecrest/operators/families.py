"""The 19 closed-form feature families of a 64-sample window, 173 columns in all.

`Families` works on a matrix of windows and computes only the families asked for;
intermediate results that several families need (centred windows, differences,
spectra, convolutions) are made once and lazily. `window_features` runs it on Arrow
batches. Dense parts are products with constant matrices; a dilated convolution is a
product of nine shifted copies with the kernels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.banks import window_banks

SIZE = 64
EPS = 1e-8
#: Families in output order, with their widths.
WIDTHS = {
    "stats": 12, "srf_mlp": 12, "autocorr": 2, "spectral": 2, "turning": 2, "trf_gausswin": 12, "crf_ppv": 32, "hilbert_env": 2, "crf_max": 32, "morphology_updown": 4,
    "fftbands": 6, "perm_entropy": 3, "curvature": 3, "conv_position": 3, "ar_residual": 4, "acf_first_min": 3, "histogram_mode": 3, "ricker_wavelet": 4, "hydra_compete": 32,
}
COLUMNS = sum(WIDTHS.values())
RICKER_SCALES = (1.5, 2.5, 4.0, 6.0)
CHUNK = 256


def responses(x: np.ndarray, kernels: np.ndarray, dilation: int) -> np.ndarray:
    """Zero-padded cross-correlation, (kernels, windows, positions): one product with the shifted copies."""
    taps = kernels.shape[1]
    pad = dilation * (taps // 2)
    wide = np.pad(x, ((0, 0), (pad, pad)))
    shifted = np.stack([wide[:, j * dilation : j * dilation + x.shape[1]] for j in range(taps)])
    return (kernels @ shifted.reshape(taps, -1)).reshape(len(kernels), *x.shape)


def dilated(x: np.ndarray, kernels: np.ndarray, dilation: int) -> np.ndarray:
    """The same as (windows, positions, kernels)."""
    return np.moveaxis(responses(x, kernels, dilation), 0, 2)


def ricker_kernels() -> np.ndarray:
    x = np.arange(-7.0, 8.0)
    rows = [(1 - (x / s) ** 2) * np.exp(-((x / s) ** 2) / 2) for s in RICKER_SCALES]
    return np.array([(r - r.mean()) / (np.abs(r).sum() + EPS) for r in rows])


def gauss_matrix(banks: dict[str, np.ndarray]) -> np.ndarray:
    grid = np.arange(SIZE) / SIZE
    w = np.exp(-((grid[:, None] - banks["trf_mu"]) ** 2) / (2 * banks["trf_sig"] ** 2 + EPS))
    return w / (w.sum(0) + EPS)


def _ddof1(x: np.ndarray) -> np.ndarray:
    return x.var(axis=1, ddof=1)


class Families:
    """Families of a matrix of windows (n, 64), as attributes of their names."""

    def __init__(self, windows: np.ndarray, banks: dict[str, np.ndarray]):
        self.w, self.banks = windows, banks

    def of(self, names: Sequence[str]) -> np.ndarray:
        return np.concatenate([getattr(self, n) for n in names], axis=1)

    @cached_property
    def mean(self) -> np.ndarray:
        return self.w.mean(1)

    @cached_property
    def centred(self) -> np.ndarray:
        return self.w - self.mean[:, None]

    @cached_property
    def step(self) -> np.ndarray:
        return np.diff(self.w, axis=1)

    @cached_property
    def bend(self) -> np.ndarray:
        return np.diff(self.w, n=2, axis=1)

    @cached_property
    def spectrum(self) -> np.ndarray:
        """Magnitudes of the bins 1 to 32."""
        return np.abs(np.fft.rfft(self.w, axis=1)[:, 1:])

    @cached_property
    def near(self) -> np.ndarray:
        return responses(self.w, self.banks["crf_w"], 2)

    @cached_property
    def far(self) -> np.ndarray:
        return responses(self.w, self.banks["crf_w"], 4)

    def lagged(self, lag: int) -> np.ndarray:
        return np.einsum("nt,nt->n", self.centred[:, :-lag], self.centred[:, lag:])

    @cached_property
    def stats(self) -> np.ndarray:
        c = self.centred
        s = np.maximum(np.sqrt(_ddof1(self.w)), EPS)
        q = np.quantile(self.w, (0.25, 0.5, 0.75), axis=1)
        head, tail = (np.sqrt((x * x).sum(1)) for x in (c[:, :-1], c[:, 1:]))
        cube = c * c * c
        return np.column_stack([
            self.mean, s, cube.mean(1) / (s**3 + EPS), (cube * c).mean(1) / (s**4 + EPS) - 3, *q, q[2] - q[0],
            self.lagged(1) / (head * tail + EPS), np.abs(self.step).mean(1), self.w.min(1), self.w.max(1),
        ])

    @cached_property
    def srf_mlp(self) -> np.ndarray:
        hidden = np.maximum(np.tensordot(self.stats, self.banks["srf_W"], axes=(1, 2)) + self.banks["srf_b"], 0)
        return (hidden * self.banks["srf_u"]).sum(2)

    @cached_property
    def autocorr(self) -> np.ndarray:
        square = self.centred**2
        return np.column_stack([self.lagged(k) / (square[:, :-k].sum(1) + EPS) for k in (1, 2)])

    @cached_property
    def spectral(self) -> np.ndarray:
        """Centre and entropy of the magnitudes as a distribution over bins."""
        weight = self.spectrum.T / (self.spectrum.sum(1) + EPS)
        return np.stack([np.tensordot(np.arange(len(weight)), weight, 1), -np.einsum("kn,kn->n", weight, np.log(weight + 1e-12))], axis=1)

    @cached_property
    def turning(self) -> np.ndarray:
        """Shares of neighbouring steps in opposite directions, and of rising steps."""
        way = np.sign(self.step).astype(np.int8)
        return np.stack([np.count_nonzero(way[:, 1:] * way[:, :-1] == -1, axis=1) / (SIZE - 2), np.count_nonzero(way == 1, axis=1) / (SIZE - 1)], axis=1)

    @cached_property
    def trf_gausswin(self) -> np.ndarray:
        return self.w @ gauss_matrix(self.banks)

    @cached_property
    def crf_ppv(self) -> np.ndarray:
        return np.concatenate([(r > 0).sum(2) for r in (self.near, self.far)]).T / SIZE

    @cached_property
    def crf_max(self) -> np.ndarray:
        return np.concatenate([r.max(2) for r in (self.near, self.far)]).T

    @cached_property
    def hilbert_env(self) -> np.ndarray:
        half = np.zeros(SIZE)
        half[[0, SIZE // 2]], half[1 : SIZE // 2] = 1, 2
        env = np.abs(np.fft.ifft(np.fft.fft(self.w, axis=1) * half, axis=1))
        level = env.mean(1) + EPS
        return np.column_stack([np.sqrt(_ddof1(env)) / level, np.abs(np.diff(env, axis=1)).mean(1) / level])

    @cached_property
    def morphology_updown(self) -> np.ndarray:
        up, down = np.maximum(self.step, 0), np.maximum(-self.step, 0)
        tops = up.max(1), down.max(1)
        return np.column_stack([*tops, np.log((tops[0] + 1e-6) / (tops[1] + 1e-6)), np.log(((up * up).sum(1) + 1e-6) / ((down * down).sum(1) + 1e-6))])

    @cached_property
    def fftbands(self) -> np.ndarray:
        power = self.spectrum**2
        share = power / (power.sum(1, keepdims=True) + EPS)
        return np.log(np.maximum(np.add.reduceat(share, np.arange(0, SIZE // 2, 6), axis=1), 1e-8))

    @cached_property
    def perm_entropy(self) -> np.ndarray:
        a, b, c = self.w[:, :-2], self.w[:, 1:-1], self.w[:, 2:]
        code = 4 * (a < b) + 2 * (b < c) + (a < c)
        share = np.stack([(code == k).mean(1) for k in (0, 2, 3, 4, 5, 7)], axis=1)
        v0, v1, v2 = (_ddof1(x) + EPS for x in (self.w, self.step, self.bend))
        mobility = np.sqrt(v1 / v0)
        return np.column_stack([-(share * np.log(share + 1e-12)).sum(1) / np.log(6), mobility, np.sqrt(v2 / v1) / (mobility + EPS)])

    @cached_property
    def curvature(self) -> np.ndarray:
        size = np.abs(self.bend)
        up, down = ((np.maximum(s * self.bend, 0) ** 2).sum(1) + 1e-6 for s in (1, -1))
        return np.column_stack([size.mean(1), size.max(1), np.log(up / down)])

    @cached_property
    def conv_position(self) -> np.ndarray:
        place = self.near.argmax(2).T / SIZE
        return np.column_stack([place.mean(1), np.sqrt(_ddof1(place)), np.ptp(place, axis=1)])

    @cached_property
    def ar_residual(self) -> np.ndarray:
        c, out = self.centred, []
        for order in (2, 3):
            past, now = [c[:, order - k : SIZE - k] for k in range(1, order + 1)], c[:, order:]
            product = lambda x, y: np.einsum("nt,nt->n", x, y)
            gram = np.stack([np.stack([product(x, y) for y in past], axis=1) for x in past], axis=1) + 1e-3 * np.eye(order)
            beta = np.linalg.solve(gram, np.stack([product(x, now) for x in past], axis=1)[..., None])[..., 0]
            rest = now - sum(beta[:, k : k + 1] * x for k, x in enumerate(past))
            out += [np.log(_ddof1(rest) + EPS), np.log(np.maximum((beta * beta).sum(1), EPS))]
        return np.column_stack(out)

    @cached_property
    def correlogram(self) -> np.ndarray:
        """Autocorrelations at lags 1 to 32, all at once from the power spectrum of the padded window."""
        power = np.abs(np.fft.rfft(self.centred, 2 * SIZE, axis=1)) ** 2
        every = np.fft.irfft(power, axis=1)
        return every[:, 1 : SIZE // 2 + 1] / (every[:, :1] + EPS)

    @cached_property
    def acf_first_min(self) -> np.ndarray:
        """Where the correlogram first dips (32 if it never does), where it first is negative, and its value at the dip."""
        r = self.correlogram
        falls = np.diff(r, axis=1) < 0
        dips = np.pad(falls[:, :-1] & ~falls[:, 1:], ((0, 0), (1, 1)))
        lag = np.argmax(dips, axis=1)
        never = lag == 0
        at = np.where(never, 1, lag)
        return np.stack([np.where(never, SIZE // 2, lag + 1) / SIZE, np.argmax(r < 0, axis=1) / SIZE, r[np.arange(len(r)), at]], axis=1)

    @cached_property
    def histogram_mode(self) -> np.ndarray:
        """Mode of a softened ten-bin histogram, its distance from the lower median, and the share of central values."""
        z = np.sort(self.centred, axis=1) / np.maximum(np.sqrt(_ddof1(self.w)), 1e-6)[:, None]
        bins = np.linspace(-2.5, 2.5, 10)
        height = np.stack([np.exp(-1.62 * np.square(z - b)).sum(1) for b in bins])
        weight = np.exp(4 * (height - height.max(0)))
        mode = bins @ weight / weight.sum(0)
        return np.stack([mode, mode - z[:, SIZE // 2 - 1], np.count_nonzero(np.abs(z) < 0.5, axis=1) / SIZE], axis=1)

    @cached_property
    def ricker_wavelet(self) -> np.ndarray:
        return (responses(self.w, ricker_kernels(), 1) > 0).sum(2).T / SIZE

    @cached_property
    def hydra_compete(self) -> np.ndarray:
        out, (groups, size, taps) = [], self.banks["hydra_w"].shape
        number = np.arange(len(self.w))[:, None] * size
        for x in (self.w, self.step):
            for dilation in (2, 4):
                every = responses(x, self.banks["hydra_w"].reshape(-1, taps), dilation).reshape(groups, size, *x.shape)
                for r in every:
                    best, winner = r[0].copy(), np.zeros(x.shape, np.int64)
                    for k in range(1, size):
                        # a later kernel wins only where it is larger
                        winner = np.where(r[k] > best, k, winner)
                        np.maximum(best, r[k], out=best)
                    share = np.bincount((number + winner).ravel(), np.maximum(best, 0).ravel(), len(x) * size).reshape(-1, size)
                    out.append(np.sqrt(share / (share.sum(1, keepdims=True) + 1e-8)))
        return np.concatenate(out, axis=1)


def phi(windows: np.ndarray, names: Sequence[str] = tuple(WIDTHS), banks: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The named families of each window, side by side; in chunks, so that intermediate results stay in cache."""
    banks = banks or window_banks()
    parts = [Families(windows[k : k + CHUNK], banks).of(names) for k in range(0, len(windows), CHUNK)]
    return np.concatenate(parts) if parts else np.empty((0, sum(WIDTHS[n] for n in names)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix; null elements are NaN. Null lists and unequal lengths are errors."""
    if not len(column):
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError(f"{column.null_count} of {len(column)} series are null; leave them out first")
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError(f"series of {lengths.min()} and of {lengths.max()} values meet where all need one length; resample or pad them first (prep), or use the embedding alone, which takes any lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def vectors(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(values, float).ravel()))


def window_features(windows: DataFrame, names: Sequence[str] = tuple(WIDTHS), banks: dict[str, np.ndarray] | None = None, keys: Sequence[str] = ("series_id", "w"), column: str = "window") -> DataFrame:
    """(keys, values): the named families of every window row."""
    names = list(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors(phi(matrix(batch.column(len(keys))), names, banks))], names=[*keys, "values"])

    source = windows.select(*keys, F.col(column))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{fields}, values array<double>")
