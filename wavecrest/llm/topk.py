"""Exact top-k by inner product with no-random-access aggregation, operator 7.

Components x become the integers floor(scale * x). The queries are a stated set of
rows. They are written to the shared folder in blocks of at most about QUERY_BLOCK, which
tasks read one at a time, so neither the driver nor a broadcast holds them, however many
they are; vectors are scanned once and never shuffle. A task takes its rows in packs of
PACK_ROWS at most, sorts each dimension of a pack once, and for every query reads the sorted
lists from their best end,
each list further in every round. What was read adds to a row's score; what was not
is bounded from above by the last value read from that list and from below by the
list's worst value. Reading stops when all rows but a few have upper bounds below the
k-th best lower bound, or below the k-th score of the pack's blocks already done; the scores of
the few are then resolved. Only a pack's k best of each query leave it, and Spark's
window limit merges them. All rows meet all queries, so work grows with their product.

Defined cases: vectors that are null, empty, or hold a null or non-finite component
take no part, nor do rows with a null id. Only vectors as long as the query are its
candidates. A query's own row is any with its id. Ties go to the smaller id. Scores
are exact while they stay below 2^62. Rows that repeat an id count each, as candidates and
as queries: query rows of one id share one ranking, in which a candidate stands once for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.llm._scratch import Scratch, readable

QUERY_BLOCK = 1024
VECTOR_BLOCK = 1024
#: Rows whose sorted lists a task holds at a time, some 2.5 kB each at 64 dimensions.
PACK_ROWS = 1 << 15
#: The lists are read this far, as shares of their length, before bounds are looked at again.
ROUNDS = (1 / 4, 1 / 2, 3 / 4)


class SortedLists:
    """A block of vectors of one length, with the rows of each dimension in both orders.

    Sums are kept as doubles, which hold them exactly while they stay below 2^52, and as
    integers otherwise.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        most = float(np.abs(rows.astype(float)).max(initial=0))
        self.kind = np.float64 if most < 2**20 and most * most * rows.shape[1] < 2**52 else np.int64
        self.ids, self.rows = ids, rows.astype(self.kind)
        self.rising = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.rows.T, self.rising, axis=1)

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of rows that may be among the k best; floor: a score that k other rows reach already."""
        n = len(self.rows)
        query = query.astype(self.kind)
        # lists of negative weights are read from their beginning, the others from their end
        down, up = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        used = np.concatenate([down, up])
        weight = query[used]
        worst = np.concatenate([self.sorted[down, n - 1], self.sorted[up, 0]]) * weight
        alive = np.flatnonzero(self.ids != query_id)
        got, seen = np.zeros(n, self.kind), np.zeros((n, len(used)), self.kind)
        read = 0
        for share in ROUNDS:
            if len(alive) <= 4 * k or not len(used):
                break
            upto = min(n, max(read + 1, int(n * share)))
            at = np.concatenate([self.rising[down, read:upto], self.rising[up, n - upto : n - read]])
            added = np.concatenate([self.sorted[down, read:upto], self.sorted[up, n - upto : n - read]]) * weight[:, None]
            if self.kind is np.float64:
                got += np.bincount(at.ravel(), added.ravel(), n)
            else:
                np.add.at(got, at.ravel(), added.ravel())
            seen[at, np.arange(len(used))[:, None]] = 1
            last = np.concatenate([self.sorted[down, upto - 1], self.sorted[up, n - upto]]) * weight
            read = upto
            unread = np.stack([worst, last], axis=1)
            low, high = (got[alive, None] + unread.sum(0) - seen[alive] @ unread).T
            bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else None
            if floor is not None and (bar is None or floor > bar):
                bar = floor
            if bar is not None:
                alive = alive[high >= bar]
        return self.ids[alive], (self.rows[alive] @ query).astype(np.int64)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of at most VECTOR_BLOCK rows, by vector length."""
    for batch in batches:
        for start in range(0, batch.num_rows, VECTOR_BLOCK):
            part = batch.slice(start, VECTOR_BLOCK)
            ids, column = part.column(0).to_numpy(), part.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            begins = np.concatenate([[0], np.cumsum(lengths)])
            yield {int(m): (ids[lengths == m], flat[begins[:-1][lengths == m][:, None] + np.arange(m)]) for m in np.unique(lengths)}


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[SortedLists]]]:
    """Sorted lists of at most about PACK_ROWS rows, by vector length."""
    held: dict[int, list[SortedLists]] = {}
    size = 0
    for blocks in _vectors(batches):
        for m, (ids, rows) in blocks.items():
            held.setdefault(m, []).append(SortedLists(ids, rows))
            size += len(ids)
        if size >= PACK_ROWS:
            yield held
            held, size = {}, 0
    if held:
        yield held


def _asked(folder: str, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ids, vector lengths, times, vectors) of one block of queries after another, from the shared folder."""
    store, base = pafs.FileSystem.from_uri(folder)
    for block in range(blocks):
        files = store.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True))
        for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
            with store.open_input_file(path) as file:
                table = pq.ParquetFile(file).read(["vec_id", "times", "row"]).combine_chunks()
            vectors = table.column("row").combine_chunks()
            edges = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy()
            yield table.column("vec_id").to_numpy(), np.diff(edges), table.column("times").to_numpy(), [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _search(batches: Iterator[pa.RecordBatch], folder: str, blocks: int, k: int) -> Iterator[pa.RecordBatch]:
    for pack in _packs(batches):
        for query_ids, lengths, times, vectors in _asked(folder, blocks):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for query_id, m, n, query in zip(query_ids.tolist(), lengths.tolist(), times.tolist(), vectors, strict=True):
                ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
                for lists in pack.get(m, ()):
                    more_ids, more_scores = lists.best(query_id, query, k, int(scores[-1]) if len(scores) == k else None)
                    ids, scores = _top(np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores]), k)
                for column, values in zip(out, (np.full(len(ids), query_id), ids, scores, np.full(len(ids), n)), strict=True):
                    column.append(values)
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "times"])


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, row of integers) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("row"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scaled(vectors, scale, id_col, vector_col)
    # equal query rows are asked once
    asked = scaled(vectors.where(is_query), scale, id_col, vector_col).groupBy("vec_id", "row").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    asked = scratch.cut(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    folder = scratch.path("blocks")
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    folder = readable(spark, folder)
    found = rows.mapInArrow(lambda it: _search(it, folder, blocks, k), "query_id long, vec_id long, score long, times long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.r, v.r)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
