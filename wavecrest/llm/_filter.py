"""A filter of bounded size that tells which rows may be needed, and dealing of hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 16 MB, whatever the input's size. On larger inputs it lets more through.
NEED_BITS = 1 << 27
#: A key of this many rows is joined in one part.
PART_ROWS = 1 << 17


def filter_bits(ids: DataFrame, slot=None) -> np.ndarray:
    """A filter of NEED_BITS bits, whatever the input's size, of the hashes of the column id (or of another slot of it)."""
    rows = (
        ids.select(((slot or id_slot)(F.col("id")) + 1).alias("s"))  # Spark counts bits from 1
        .groupBy(F.bitmap_bucket_number("s").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .toLocalIterator()
    )
    bits = np.zeros(NEED_BITS // 8, np.uint8)
    for bucket, part in rows:
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(part), np.uint8)
    return bits


def id_slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(NEED_BITS))


def hash_slot(column: Column) -> Column:
    """The slot of a column that holds hashes already."""
    return column.bitwiseAND(F.lit(NEED_BITS - 1))


def chosen(slot: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each slot is set."""
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def dealt(rows: DataFrame) -> DataFrame:
    """The written rows (with the column row) with part__: rows of one key fall into so many parts, dealt by
    row, that a key which a third of all rows hold makes parts of about PART_ROWS rows at most."""
    parts = max(64, -(-rows.count() // PART_ROWS))
    return rows.withColumn("part__", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(parts)))
