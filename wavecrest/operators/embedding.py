"""Pooling of window features into series embeddings.

Two physical forms give the same numbers. `pooled` aggregates rows of window features
by series with Spark's partial aggregates (one shuffle of three numbers per column).
`embed` keeps a series and its windows in one row of an Arrow batch, computes the
features and pools them there, with no shuffle and no row per window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.banks import load_banks, window_banks
from wavecrest.operators.families import SIZE, WIDTHS, phi, vectors
from wavecrest.operators.prep import HOP

OPERATIONS = ("mean", "std", "max")
#: The pruned pooling, operations kept for each family.
PRUNED = {
    "srf_mlp": ("max",), "spectral": ("max",), "trf_gausswin": ("mean",), "crf_ppv": ("mean", "std"), "crf_max": ("mean",), "morphology_updown": ("std",),
    "perm_entropy": ("max",), "curvature": ("mean",), "conv_position": ("max",), "ar_residual": ("mean", "max"), "ricker_wavelet": ("mean",), "hydra_compete": ("mean", "std"),
}
POOLINGS = {"full": None, "pruned": PRUNED}
#: Windows after which a block of series is computed; a series with more is pooled in pieces of so many.
BLOCK_WINDOWS = 4096


def output_dim(pooling: str = "full") -> int:
    if pooling == "full":
        return 3 * sum(WIDTHS.values())
    return sum(WIDTHS[f] * len(ops) for f, ops in POOLINGS[pooling].items())


def pooled(features: DataFrame, keys: Sequence[str] = ("series_id",), operations: Sequence[str] = OPERATIONS) -> DataFrame:
    """(keys, op, col, val): mean, population std and max over all windows of a key."""
    aggregate = {"mean": F.avg("v"), "std": F.stddev_pop("v"), "max": F.max("v")}
    rows = features.select(*keys, F.posexplode("values").alias("col", "v"))
    wide = rows.groupBy(*keys, "col").agg(*[aggregate[o].alias(o) for o in operations])
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.col(o).alias("val")) for o in operations]))
    return wide.select(*keys, "col", each.alias("p")).select(*keys, "p.op", "col", "p.val")


def _znorm(values: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        z = (values - values.mean()) / (values.std() + 1e-8)
    return np.nan_to_num(z)


def starts(values: np.ndarray, resample: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One channel, lengthened to a window where it is shorter, and where its windows begin."""
    n = len(values)
    if n < SIZE:
        values = np.interp(np.arange(SIZE) * (n - 1) / (SIZE - 1), np.arange(n), values) if resample and n >= 2 else np.concatenate([np.full(SIZE - n, values[0]), values])
        n = SIZE
    return values, np.unique(np.append(np.arange(0, n - SIZE + 1, HOP), n - SIZE))


def cut(values: np.ndarray, resample: bool = True) -> np.ndarray:
    """The 64-sample windows of one channel."""
    values, at = starts(values, resample)
    return values[at[:, None] + np.arange(SIZE)]


def _pool(features: np.ndarray, counts: np.ndarray, names: Sequence[str], keep: dict | None) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    mean = np.add.reduceat(features, starts) / counts[:, None]
    spread = np.sqrt(np.add.reduceat((features - np.repeat(mean, counts, axis=0)) ** 2, starts) / counts[:, None])
    return _chosen({"mean": mean, "std": spread, "max": np.maximum.reduceat(features, starts)}, names, keep)


def _chosen(by: dict[str, np.ndarray], names: Sequence[str], keep: dict | None) -> np.ndarray:
    """The pooled columns in output order."""
    if keep is None:
        return np.concatenate([by[o] for o in OPERATIONS], axis=1)
    out, at = [], 0
    for f in names:
        out += [by[o][:, at : at + WIDTHS[f]] for o in OPERATIONS if o in keep[f]]
        at += WIDTHS[f]
    return np.concatenate(out, axis=1)


def _pool_in_pieces(channels: list[tuple[np.ndarray, np.ndarray]], names: Sequence[str], keep: dict | None, banks: dict[str, np.ndarray] | None) -> np.ndarray:
    """The pooled row of one series with very many windows: BLOCK_WINDOWS of them at a time, their moments merged."""
    n, mean, about, top = 0, 0.0, 0.0, -np.inf
    for values, at in channels:
        for k in range(0, len(at), BLOCK_WINDOWS):
            part = phi(values[at[k : k + BLOCK_WINDOWS, None] + np.arange(SIZE)], names, banks)
            m, own = len(part), part.mean(0)
            off = own - mean
            about = about + ((part - own) ** 2).sum(0) + off * off * (n * m / (n + m))
            mean, n, top = mean + off * (m / (n + m)), n + m, np.maximum(top, part.max(0))
    return _chosen({"mean": mean[None], "std": np.sqrt(about / n)[None], "max": top[None]}, names, keep)


def embed_matrix(x: np.ndarray, pooling: str = "full", banks: dict[str, np.ndarray] | None = None, resample: bool = True) -> np.ndarray:
    """Embeddings of equal-length series, as rows."""
    names = list(WIDTHS) if pooling == "full" else [f for f in WIDTHS if f in PRUNED]
    cuts = [cut(_znorm(row), resample) for row in x]
    return _pool(phi(np.concatenate(cuts), names, banks or window_banks()), np.array([len(c) for c in cuts]), names, POOLINGS[pooling])


def embed(series: DataFrame, pooling: str = "full", column: str = "x", key: str = "series_id", keep: Sequence[str] = (), resample: bool = True, partitions: int | None = None, banks: dict[str, np.ndarray] | str | None = None) -> DataFrame:
    """(key, keep columns, embedding). banks: own window banks, or an npz file of them. partitions: deal the series anew over so many tasks, where they lie in fewer than there are cores.

    `column` is an array, or an array of channels whose windows pool as one bag.

    Empty and null channels have no windows; a series without any gets a null embedding.
    """
    nested = series.schema[column].dataType.elementType.typeName() == "array"
    names, chosen = (list(WIDTHS) if pooling == "full" else [f for f in WIDTHS if f in PRUNED]), POOLINGS[pooling]
    banks = load_banks(banks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            counts: list[int] = []
            done: list[np.ndarray] = []

            def flush() -> None:
                if not counts:
                    return
                n = np.array(counts)
                out = np.full((len(n), output_dim(pooling)), np.nan)
                if (n > 0).any():
                    out[n > 0] = _pool(phi(np.concatenate(held), names, banks), n[n > 0], names, chosen)
                done.append(out)
                held.clear()
                counts.clear()

            values = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                cell = values[i]
                channels = ([c.values for c in cell.values] if nested else [cell.values]) if cell.is_valid else []
                own = [starts(_znorm(c.to_numpy(zero_copy_only=False)), resample) for c in channels if c is not None and len(c)]
                size = sum(len(at) for _, at in own)
                # a block and the next series together stay below twice BLOCK_WINDOWS
                if size > BLOCK_WINDOWS:
                    flush()
                    done.append(_pool_in_pieces(own, names, chosen, banks))
                    continue
                counts.append(size)
                held += [x[at[:, None] + np.arange(SIZE)] for x, at in own]
                if sum(counts) > BLOCK_WINDOWS or len(counts) >= 256:
                    flush()
            flush()
            if done:
                out = np.concatenate(done)
                array, none = vectors(out), np.isnan(out).all(axis=1)
                if none.any():
                    array = pa.array([None if m else row for m, row in zip(none, out, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], array], names=[key, *keep, "embedding"])

    source = series.select(key, *keep, F.col(column))
    source = source.repartition(partitions) if partitions else source
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{fields}, embedding array<double>")
