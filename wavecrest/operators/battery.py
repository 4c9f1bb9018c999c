"""Seventeen blocks of nonlinear random features over a standardised embedding, 241 columns.

A row's rank channel always holds the same values in another order, so two blocks
(rank histogram and rank quantiles) are the same for all rows; they are computed once
per width and repeated, not per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.banks import battery_banks
from wavecrest.operators.families import matrix, vectors


def rank_channel(z: np.ndarray) -> np.ndarray:
    """Within-row ranks, ties by column, spread evenly around 0 with unit variance."""
    rank = np.empty(z.shape)
    np.put_along_axis(rank, z.argsort(axis=1, kind="stable"), np.arange(z.shape[1], dtype=float)[None, :], axis=1)
    return (rank / (z.shape[1] - 1) - 0.5) * np.sqrt(12.0)


def _landmarks(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.exp(-np.stack([((z - row) ** 2).mean(1) for row in a], axis=1))


def rank_constants(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank histogram and rank quantiles, which depend on the width alone."""
    xr = (np.arange(dims) / (dims - 1) - 0.5) * np.sqrt(12.0)
    return np.exp(-((xr[:, None] - np.linspace(-2, 2, 8)) ** 2)).mean(0), np.quantile(xr, np.arange(9) / 8)


def _tanh(x):
    return np.tanh(x)


#: Block -> (its channel, bank, function of the product over the root of the width), in output order.
BLOCKS = {
    "tanh": ("z", "W501", _tanh),
    "tanh_ssq": ("ssq", "W801", _tanh),
    "tanh_slg": ("slg", "W701", _tanh),
    "tanh_ssqrank": ("ssqrank", "W1901", _tanh),
    "cos": ("z", "W201", lambda x: np.cos(x + battery_banks(1)["b202"])),
    "cos_rank3": ("rank", "W4011", lambda x: np.cos(x / 3 + battery_banks(1)["b4012"])),
    "cos_w6041": ("rank", "W6041", np.cos),
    "cos_w6042": ("rank", "W6042", lambda x: np.cos(x / 3)),
    "relu_rank": ("rank", "W321", lambda x: np.maximum(x, 0)),
    "sq_rank": ("rank", "W322", np.square),
    "relu_rank24": ("rank", "W7011", lambda x: np.maximum(x, 0)),
    "sigmoid_rank": ("rank", "W951", lambda x: 1 / (1 + np.exp(-8 * x))),
    "log1p": ("z", "W5141", lambda x: np.log1p(np.abs(x))),
    "landmark8": ("z", "A209", None),
    "landmark12": ("z", "A6091", None),
    "rankhist": (None, None, None),
    "rankquant": (None, None, None),
}


def battery(z: np.ndarray, names: Sequence[str] = tuple(BLOCKS)) -> np.ndarray:
    n, dims = z.shape
    banks, size, root = battery_banks(dims), np.abs(z), np.sqrt(dims)
    channels = {"z": z}
    wanted = {BLOCKS[b][0] for b in names}
    if wanted & {"rank", "ssqrank"}:
        channels["rank"] = rank_channel(z)
    if wanted & {"ssq", "ssqrank"}:
        channels["ssq"] = np.sign(z) * np.sqrt(size)
    if "ssqrank" in wanted:
        channels["ssqrank"] = channels["ssq"] * channels["rank"]
    if "slg" in wanted:
        channels["slg"] = np.sign(z) * np.log1p(size)
    out = []
    for name in names:
        channel, bank, function = BLOCKS[name]
        if bank is None:
            out.append(np.broadcast_to(rank_constants(dims)[0 if name == "rankhist" else 1], (n, 8 if name == "rankhist" else 9)))
        elif function is None:
            out.append(_landmarks(z, banks[bank]))
        else:
            out.append(function(channels[channel] @ banks[bank] / root))
    return np.concatenate(out, axis=1)


def with_battery(df: DataFrame, column: str = "z", names: Sequence[str] = tuple(BLOCKS), output: str = "values", keep: Sequence[str] = ("series_id",), append: bool = False) -> DataFrame:
    """(keep, output): battery blocks of a standardised vector column; append: the vector itself first."""
    names = list(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                z = matrix(part.column(part.num_columns - 1))
                made = battery(z, names)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors(np.concatenate([z, made], axis=1) if append else made)], names=[*keep, output])

    source = df.select(*keep, F.col(column))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{fields}{output} array<double>")
