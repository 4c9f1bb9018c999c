"""Series from tables: vectors as they are, and ordered values of events, lines and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(table: DataFrame, key: str, order: Sequence[str], value: str | Sequence[str]) -> DataFrame:
    """(series_id, x or channels): the values of each key in a total order. One shuffle by key."""
    values = [value] if isinstance(value, str) else list(value)
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    grouped = table.groupBy(F.col(key).alias("series_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    arrays = [F.col("rows")[f"v{i}"] for i in range(len(values))]
    return grouped.select("series_id", arrays[0].alias("x") if isinstance(value, str) else F.array(*arrays).alias("channels"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: (series_id, x, label), 64 values each."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: each user's event values in time order."""
    return from_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ("ts", "event_id"), "value")


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: each supplier's extended prices by ship date."""
    return from_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", LINE_ORDER, "l_extendedprice")


def supplier_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", LINE_ORDER, CHANNELS)


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: short series, each customer's order totals."""
    return from_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice")


def is_test(key: Column) -> Column:
    return key % 5 == 0
