"""Joining texts with lists of what they lose, so that texts which lose nothing stay where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from wavecrest.llm._filter import chosen, filter_bits, id_slot
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import slices

Work = Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]]


def _chosen(batches: Iterator[pa.RecordBatch], needed, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose slot (the last column) is set in the filter, or those whose slot is not; without the slot."""
    for part in slices(batches, "text"):
        hit = chosen(part.column(part.num_columns - 1).to_numpy(), needed.value)
        part = part.select(list(range(part.num_columns - 1)))
        if (hit if inside else ~hit).any():
            yield part.filter(pa.array(hit if inside else ~hit))


def shielded(base: DataFrame, *keep: str) -> dict[str, str]:
    """A name for each column that no operator uses, and that Python stages can pass on; those in keep keep theirs."""
    return {c: c if c in keep else f"column_{k}__" for k, c in enumerate(base.columns)}


def _unlisted(batches: Iterator[pa.RecordBatch], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for part in batches:
        yield part.append_column(pa.field(name, kind), pa.nulls(part.num_rows, kind))


def apply_lists(base: DataFrame, lists: DataFrame, name: str, work: Work, out: StructType, scratch: Scratch) -> DataFrame:
    """base (with doc_id and text) through work, which finds each row's list in the column `name`, null where it has none.

    lists: (lost_id__, name), one row for each document that has a list. A filter of bounded size tells which
    texts may have one: only those shuffle, the others go through work where they lie.
    """
    lists = scratch.cut(lists, "lists")
    names = shielded(base, "doc_id", "text")
    safe = base.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    inner = StructType([StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in out])
    needed = base.sparkSession.sparkContext.broadcast(filter_bits(lists.select(F.col("lost_id__").alias("id"))))
    marked = safe.withColumn("slot__", id_slot(F.col("doc_id").cast("long")))
    arrow, kind = to_arrow_schema(inner), to_arrow_schema(lists.schema).field(name).type
    listed = marked.mapInArrow(lambda b: _chosen(b, needed, True), safe.schema)
    listed = listed.join(lists.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("lost_id__"), "left").drop("lost_id__")
    rest = marked.mapInArrow(lambda b: work(_unlisted(_chosen(b, needed, False), name, kind), arrow), inner)
    made = rest.unionByName(listed.mapInArrow(lambda b: work(b, arrow), inner))
    return made.select(*[F.col(names.get(f.name, f.name)).alias(f.name) for f in out])


def without(base: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """base (with text) without the rows whose `key`, a long, is a row of gone, a written table; only rows that may be in it shuffle."""
    names = shielded(base, "text")
    needed = base.sparkSession.sparkContext.broadcast(filter_bits(gone.select(F.col("row").alias("id"))))
    safe = base.select(key.alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    marked = safe.withColumn("slot__", id_slot(F.col("row")))
    suspects = marked.mapInArrow(lambda b: _chosen(b, needed, True), safe.schema).join(gone.select("row").distinct(), "row", "left_anti")
    left = marked.mapInArrow(lambda b: _chosen(b, needed, False), safe.schema).unionByName(suspects)
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
