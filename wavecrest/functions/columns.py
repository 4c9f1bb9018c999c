"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0, so that engines print equal values alike."""
    r = F.round(value, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.asarray(values, float).ravel()])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def long(df: DataFrame, keys: Sequence[str], values: str = "values", digits: int = 6) -> DataFrame:
    """One row for each array element: the keys, col (from 0) and the rounded val."""
    return df.select(*keys, F.posexplode(values).alias("col", "val")).withColumn("val", rounded(F.col("val"), digits))


def columns_long(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    return long(df.select(*keys, F.array(*columns).alias("values")), keys)
