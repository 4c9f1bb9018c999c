"""Series preparation: normalising, scrubbing, resampling, padding, window cutting.

All of it is column expressions on `series_id, x array<double>`. A series without
values has no windows: such rows are dropped by `windows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, HOP = 64, 16
BIGGEST = 1.7976931348623157e308


def znorm(x: Column) -> Column:
    """(x - mean) / (population std + 1e-8); a NaN or infinity anywhere makes all values NaN."""
    n = F.size(x)
    # sum and running squares, value by value as the SQL's avg and stddev_pop add them: where interpolated values tie, families compare last bits
    seen = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "sum", "mean", "sq")])

    def add(a: Column, v: Column) -> Column:
        mean = a["mean"] + (v - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), (a["sum"] + v).alias("sum"), mean.alias("mean"), (a["sq"] + (v - a["mean"]) * (v - mean)).alias("sq"))

    # struct lets the mean and deviation be computed once for all elements
    m = F.transform(F.array(F.aggregate(x, seen, add)), lambda a: F.struct((a["sum"] / n).alias("m"), F.sqrt(a["sq"] / n).alias("s")))[0]
    return F.flatten(F.transform(F.array(m), lambda q: F.transform(x, lambda v: (v - q["m"]) / (q["s"] + 1e-8))))


def scrub(x: Column) -> Column:
    """NaN and null to 0, infinities to the largest doubles."""
    inf = F.lit(float("inf"))
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).when(v == inf, BIGGEST).when(v == -inf, -BIGGEST).otherwise(v))


def scrub_zero(x: Column) -> Column:
    """Everything that isn't finite to 0: the order after scaling."""
    inf = F.lit(float("inf"))
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == inf), 0.0).otherwise(v))


def resample_short(x: Column, size: int = SIZE) -> Column:
    """Linear interpolation of 2 and more values at `size` even positions."""
    last = F.size(x) - 1

    def at(i: Column) -> Column:
        pos = i * last / F.lit(float(size - 1))
        low = F.least(F.floor(pos).cast("int"), last - 1)
        left, right = F.get(x, low), F.get(x, low + 1)
        return left + (right - left) * (pos - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def edge_pad(x: Column, size: int = SIZE) -> Column:
    """The first value repeated on the left up to `size` values."""
    return F.concat(F.array_repeat(F.get(x, F.lit(0)), F.greatest(F.lit(size) - F.size(x), F.lit(0))), x)


def lengthened(x: Column, resample: bool = True, size: int = SIZE) -> Column:
    n = F.size(x)
    short = F.when(n >= 2, resample_short(x, size)).otherwise(edge_pad(x, size)) if resample else edge_pad(x, size)
    return F.when(n < size, short).otherwise(x)


def starts(x: Column, size: int = SIZE, hop: int = HOP) -> Column:
    """Window starts: every hop, and one window that ends with the series."""
    last = F.size(x) - size
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(hop)), F.array(last)))


def diff(x: Column) -> Column:
    return F.when(F.size(x) < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a))


def diff_padded(x: Column) -> Column:
    """Differences with one 0 at the end, as long as x."""
    return F.concat(diff(x), F.array(F.lit(0.0)))


def normalised(series: DataFrame, column: str = "x") -> DataFrame:
    """series with x z-normalised and scrubbed, without empty series."""
    clean = series.where(F.size(column) > 0)
    return clean.withColumn(column, scrub(znorm(F.col(column))))


def windows(series: DataFrame, resample: bool = True, normalise: bool = True) -> DataFrame:
    """(series_id, w, start, window): 64-sample windows of the prepared series."""
    ready = normalised(series) if normalise else series.where(F.size("x") > 0).withColumn("x", scrub(F.col("x")))
    ready = ready.select("series_id", lengthened(F.col("x"), resample).alias("x"))
    cut = ready.select("series_id", "x", F.posexplode(starts(F.col("x"))).alias("w", "start"))
    return cut.select("series_id", "w", "start", F.slice("x", F.col("start") + 1, SIZE).alias("window"))
