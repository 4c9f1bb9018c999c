"""Near-duplicate documents by SetSketch registers, operator 5.

A document is the set of its distinct word shingles (A-Z lower-cased, words are runs
of anything but white space). Two documents are linked when their sets' Jaccard
similarity is at least `percent` / 100; groups are connected components.

Method.
1. One scan gives each document its set's size, a 128-bit digest of the set, and a
   SetSketch: `bands * rows` registers, each the truncated logarithm (base e^LOG_BASE)
   of the least exponential hash of the set. Registers merge by maximum.
2. Equal sets fold into a class by digest, so copies are never paired.
3. Runs of `rows` registers are band values. Within a bucket of equal band values
   every class is compared with the bucket's smallest id only.
4. A pair goes on to verification when the maximum-likelihood similarity, estimated
   jointly from the counts of larger, smaller and equal registers and the known set
   sizes, is at least SURE. Verification compares full sets of 64-bit shingle hashes.
5. Components of the verified links are found. Buckets that still hold several
   components compare their classes with a second one, chosen by a hash of bucket and id, so
   that the buckets of one group ask many different ones; components are found again.
6. Buckets that are still open compare the rest of their classes across components, first by
   registers and then by full sets. A class is one row of that stage, in the block of its bucket
   where it lies; blocks have BLOCK classes and BLOCK_SHINGLES shingles at the most (a longer
   text is a block's only excess). The task of a block reads the bucket's other blocks, one at
   a time, from the shared folder. Components that a link joins count as one from then on, and
   a pair is looked at in the first band it shares only. Rows are linear in the classes;
   the look itself is quadratic in those of a bucket that belong to different components, which is
   what it takes to pass over no link.
At 0.8 similarity a pair shares none of the 40 bands of 5 with probability 6e-8.

Defined cases: null and empty texts, and those of white space alone, have an empty
set and are linked with nothing. A text with fewer words than a shingle has its whole
sequence as the one element. Rows that repeat a doc_id are one document, which links whatever
each of its texts is linked with; rows with a null doc_id are linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm._filter import chosen, filter_bits, id_slot
from wavecrest.llm._scratch import Scratch, readable
from wavecrest.llm._text import WordHashes, as_bytes, mix, shingle_hashes, slices
from wavecrest.llm.components import connected_components, extended

LOG_BASE = 0.08
#: Exponential values above this are truncated to register 0, those below TOP * e^(-254 * LOG_BASE) to 254.
TOP = 16.0
#: Pairs are verified from this estimate on; 0.8 lies five standard errors above it at 200 registers.
SURE = 0.66
BLOCK = 2000
BLOCK_SHINGLES = 1 << 21


def multipliers(registers: int) -> np.ndarray:
    return mix(np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers_of(least: np.ndarray) -> np.ndarray:
    """Register values of least 64-bit hashes: 1 - log_b of the exponential value, truncated to 0..254."""
    value = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53))
    with np.errstate(divide="ignore"):
        k = np.floor(1 + (np.log(TOP) - np.log(value)) / LOG_BASE)
    return np.clip(k, 0, 254).astype(np.uint8)


def text_set(text: bytes, width: int, words: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(words.of(text.lower().split()), width))


def _sketches(batches: Iterator[pa.RecordBatch], width: int, registers: int) -> Iterator[pa.RecordBatch]:
    words, factors = WordHashes(), multipliers(registers)
    for part in slices(batches, "text", most_bytes=1 << 19):
        sets = [text_set(t, width, words) for t in as_bytes(part.column(1))]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        out = np.zeros((len(sets), registers), np.uint8)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            least = np.empty((registers, len(full)), np.uint64)
            room = np.empty_like(flat)
            for k in range(registers):
                np.multiply(flat, factors[k], out=room)
                np.minimum.reduceat(room, starts, out=least[k])
            out[full] = registers_of(least).T
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.dtype("<i8")).reshape(-1, 2)
        empty = sizes == 0
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column(0),
            "n": pa.array(sizes),
            "d1": pa.array(digests[:, 0], mask=empty),
            "d2": pa.array(digests[:, 1], mask=empty),
            "sketch": pa.array([row.tobytes() if n else None for row, n in zip(out, sizes, strict=True)], pa.binary()),
        })


def _bands(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bands = sketch.shape[1] // rows
        band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (batch.num_rows, bands)).copy()
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, k::rows][:, :bands])
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key.ravel().view(np.int64)), "rep": pa.array(np.repeat(ids, bands)), "band": pa.array(band)})


def likely(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair is to be verified: its sizes allow the similarity, and the joint estimate is at least SURE.

    The likelihood of the three counts is concave in the similarity, so its maximum lies
    at or above SURE where its slope there is not negative.
    """
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    possible = 100 * least >= percent * most
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(SURE, least / most)
    c = 1 - np.exp(-LOG_BASE)
    p = lambda x: -np.log1p(-x * c) / LOG_BASE
    slope = lambda x: c / (1 - x * c) / LOG_BASE
    a, b = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
    up, down = np.maximum(p(a), 1e-12), np.maximum(p(b), 1e-12)
    rise = -larger * v * slope(a) / up - smaller * u * slope(b) / down + equal * (v * slope(a) + u * slope(b)) / np.maximum(1 - up - down, 1e-12)
    return possible & ((rise >= 0) | (j < SURE))


def _estimate(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, n_a, n_b, s_a, s_b = batch.columns[:6]
        s_a, s_b = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for s in (s_a, s_b))
        good = likely((s_a > s_b).sum(1), (s_a < s_b).sum(1), (s_a == s_b).sum(1), n_a.to_numpy(), n_b.to_numpy(), percent)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good))


class _Sets:
    """Shingle sets of packed texts, the last few kept: of `keep` elements together, and at least one pair's."""

    def __init__(self, width: int, keep: int = BLOCK_SHINGLES):
        self.width, self.keep, self.held = width, keep, 0
        self.words, self.unpack = WordHashes(), zstandard.ZstdDecompressor()
        self.recent: dict[bytes, np.ndarray] = {}

    def of(self, packed: bytes) -> np.ndarray:
        if (known := self.recent.get(packed)) is not None:
            return known
        if self.held > self.keep:
            self.recent.clear()
            self.held = 0
        out = self.recent[packed] = text_set(self.unpack.decompress(packed), self.width, self.words)
        self.held += len(out)
        return out

    def linked(self, a: bytes, b: bytes, percent: int) -> bool:
        s_a, s_b = self.of(a), self.of(b)
        shared = len(np.intersect1d(s_a, s_b, assume_unique=True))
        return 100 * shared >= percent * (len(s_a) + len(s_b) - shared)


class _Joined:
    """Components that have become one, as a forest of their ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while c in self.up:
            c = self.up[c]
        return c

    def of(self, components: np.ndarray) -> np.ndarray:
        names, back = np.unique(components, return_inverse=True)
        return np.array([self.root(int(c)) for c in names], np.int64)[back]


class _Block:
    """Classes of one block of a bucket, as arrays."""

    def __init__(self, table: pa.Table, joined: _Joined):
        table = table.combine_chunks()
        self.rep, self.n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        self.comp = joined.of(table.column("comp").to_numpy())
        self.packed = table.column("packed").to_pylist()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(self.rep), -1)


def _links(left: _Block, right: _Block, pivot: int, band: int, rows: int, joined: _Joined, sets: _Sets, percent: int) -> list[tuple[int, int]]:
    """Links between components of two blocks (or inside one); one for each two components at most."""
    found = []
    for i in np.flatnonzero(left.rep != pivot):
        open_ = (right.comp != left.comp[i]) & (right.rep != pivot)
        if right is left:
            open_[: i + 1] = False
        other = np.flatnonzero(open_)
        if not len(other):
            continue
        big, own = right.sketch[other], left.sketch[i]
        equal = own == big
        count = equal.sum(1)
        good = np.flatnonzero(likely((own > big).sum(1), own.shape[0] - count - (own > big).sum(1), count, np.full(len(other), left.n[i]), right.n[other], percent))
        if not len(good):
            continue
        # a pair that shares an earlier band was looked at in that band's bucket
        good = good[equal[good].reshape(len(good), -1, rows).all(2).argmax(1) == band]
        for j in other[good][np.argsort(-count[good], kind="stable")]:
            a, b = int(left.comp[i]), int(right.comp[j])
            if a != b and sets.linked(left.packed[i], right.packed[j], percent):
                found.append((int(left.rep[i]), int(right.rep[j])))
                joined.up[b] = a
                left.comp[left.comp == b] = a
                right.comp[right.comp == b] = a
    return found


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each combination of the columns' values; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and tuple(key[start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _across(batches: Iterator[pa.RecordBatch], width: int, percent: int, rows: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Links across components, a block of a bucket at a time against itself and half of the bucket's other blocks."""
    sets = _Sets(width)
    for table in _groups(batches, ("key", "own")):
        key, own, blocks, pivot, band = (int(table.column(c)[0].as_py()) for c in ("key", "own", "blocks", "pivot", "band"))
        joined = _Joined()
        left = _Block(table, joined)
        found = _links(left, left, pivot, band, rows, joined, sets, percent)
        for step in range(1, blocks // 2 + 1):
            other = (own + step) % blocks
            # of two opposite blocks the first one looks
            if 2 * step == blocks and other < own:
                continue
            for part in _stored(folder, key, other):
                left.comp = joined.of(left.comp)
                found += _links(left, _Block(part, joined), pivot, band, rows, joined, sets, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found, strict=True)], names=["a", "b"])


def _stored(folder: str, key: int, own: int) -> Iterator[pa.Table]:
    """The files of one block in the shared folder."""
    store, base = pafs.FileSystem.from_uri(folder)
    files = store.get_file_info(pafs.FileSelector(f"{base}/key={key}/own={own}", allow_not_found=True))
    for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
        with store.open_input_file(path) as file:
            yield pq.ParquetFile(file).read(["rep", "n", "comp", "sketch", "packed"])


def _pack(batches: Iterator[pa.RecordBatch], needed) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for part in slices(batches, "text"):
        wanted = np.flatnonzero(chosen(part.column(2).to_numpy(), needed.value))
        if len(wanted):
            part = part.take(pa.array(wanted))
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "packed": pa.array([press.compress(t) for t in as_bytes(part.column(1))], pa.binary())})


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    sets = _Sets(width, BLOCK_SHINGLES // 8)
    for batch in batches:
        good = [sets.linked(p_a, p_b, percent) for p_a, p_b in zip(*(c.to_pylist() for c in batch.columns[2:4]), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def packed_texts(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, packed) of at least the documents in ids: a bounded filter of their hashes picks the texts in one scan."""
    needed = docs.sparkSession.sparkContext.broadcast(filter_bits(ids))
    texts = docs.select("doc_id", "text", id_slot(F.col("doc_id")).alias("slot"))
    return scratch.cut(texts.mapInArrow(lambda b: _pack(b, needed), "id long, packed binary"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity; texts: (id, packed) of at least the paired documents."""
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("p_b"))
    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("p_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "p_a", "p_b")
    return scratch.cut(joined.mapInArrow(lambda b: _verify(b, width, percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, result: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    registers = bands * rows
    signed = scratch.cut(base.mapInArrow(lambda b: _sketches(b, width, registers), "doc_id long, n long, d1 long, d2 long, sketch binary"), "signed")
    known = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.cut(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    owned = known.join(classes, ["d1", "d2"])
    reps = scratch.cut(owned.where("doc_id = rep").select("rep", "n", "sketch", "d1", "d2").dropDuplicates(["rep", "d1", "d2"]), "reps").drop("d1", "d2")
    owned = scratch.cut(owned.select("doc_id", "rep"), "owned")
    banded = reps.select("rep", "sketch").mapInArrow(lambda b: _bands(b, rows), "key long, rep long, band int")
    buckets = scratch.cut(banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most"), F.count("*").alias("size")).where("most > pivot").drop("most"), "buckets")
    members = scratch.cut(banded.join(buckets, "key"), "members")

    # classes that share a doc_id are linked by it
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc_id", "a")
    by_id = scratch.cut(owned.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "by-id")

    def estimated(pairs: DataFrame) -> DataFrame:
        sketches = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        compared = pairs.join(sketches("b"), "b").join(sketches("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        return scratch.cut(compared.mapInArrow(lambda b: _estimate(b, percent), "a long, b long").distinct(), "pairs")

    def still_open(labelled: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component."""
        labelled = scratch.cut(labelled, "labelled")
        keys = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
        return scratch.cut(labelled.join(scratch.cut(keys, "open"), "key"), "rest")

    def label(rows_: DataFrame, found: DataFrame) -> DataFrame:
        return rows_.join(found, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "pivot", "size", F.coalesce("component", "rep").alias("comp"))

    texts = base.where("doc_id IS NOT NULL")
    pairs = estimated(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    packed = packed_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts, scratch)
    links = verified(pairs, packed, scratch, width, percent).unionByName(by_id)
    scratch.drop(packed)
    found = scratch.cut(connected_components(links, scratch), "components")

    rest = still_open(label(members.where("size > 2"), found))
    if not rest.isEmpty():
        packed = packed_texts(rest.select(F.col("rep").alias("id")), texts, scratch)
        chance = F.xxhash64("key", "rep")
        second = rest.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), chance).alias("second"))
        asked = rest.join(second, "key").where("comp <> second.comp").select(F.least("rep", "second.rep").alias("a"), F.greatest("rep", "second.rep").alias("b")).distinct()
        found = extended(found, verified(estimated(asked), packed, scratch, width, percent), scratch)

        rest = still_open(label(rest.drop("comp"), found)).join(reps.join(packed.withColumnRenamed("id", "rep"), "rep"), "rep")
        rest = scratch.cut(rest, "open-classes")
        blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("long")
        sizes = scratch.cut(rest.groupBy("key").agg(blocks.alias("blocks")), "block-counts")
        rest = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
        columns = ["key", "own", "blocks", "band", "rep", "pivot", "comp", "n", "sketch", "packed"]
        rest = scratch.cut(rest.select(*columns), "blocked")
        folder = scratch.path("blocks")
        stored = rest.where("blocks > 1").repartition("key", "own")
        stored.write.partitionBy("key", "own").option("compression", "zstd").parquet(folder)
        folder = readable(spark, folder)
        more = rest.repartition("key", "own").sortWithinPartitions("key", "own").mapInArrow(lambda b: _across(b, width, percent, rows, folder), "a long, b long").distinct()
        more = scratch.cut(more, "more")
        if not more.isEmpty():
            found = extended(found, more, scratch)

    per_doc = owned.join(found, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select(F.col("doc_id"), F.col("n").alias("n_shingles")).join(per_doc.withColumnRenamed("doc_id", "id__"), F.col("doc_id") == F.col("id__"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return scratch.result(out) if result else out


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE
  list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
pair AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, pair.y FROM r JOIN pair ON r.c = pair.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = s.doc_id
"""
