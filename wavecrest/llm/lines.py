"""Line deduplication by two Bloom filters, operator 6.

A line's key is the line stripped of white space at both ends and with A-Z
lower-cased. Keys of at least `min_chars` code points that occur in at least
`min_docs` documents keep their lines in the document with the largest id only.

Method. First scan: every task enters the hashes of its keys into two Bloom
filters, seen once and seen twice (in different rows); the tasks' filters are merged
shard by shard, where a bit set in two tasks' once-filters counts as seen twice.
The merged twice-filter has no false negatives. Its size follows from the bytes of all
texts, up to the documented FILTER_BITS, so what is broadcast is bounded; on larger inputs
it lets more through, which costs shuffle, never a result. Second scan: only lines in the
twice-filter shuffle, as 128-bit hashes with their document. Exact counts per hash
confirm the repeats and choose the document that keeps the line. Counting is
pre-aggregated by (hash, document), so a line that a third of all documents hold
meets in one task as a few partial sums. The removal lists, bounded by a document's
own lines, join the texts by doc_id; texts that lose nothing don't shuffle (`_lists`).

Defined cases: null and empty texts are one empty line. Rows with a null doc_id take
no part and keep all lines. Rows that repeat a doc_id count as one document, and all
of them lose or keep a line alike. Lines repeated inside the keeping document stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavecrest.llm._lists import apply_lists
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import as_bytes, mix, slices

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text for each bit of a Bloom filter (16 bits for a line of 128 bytes), up to FILTER_BITS: 128 MB, the most that is broadcast.
BIT_BYTES = 8
FILTER_BITS = 1 << 30
SHARD_BITS = 1 << 22
PROBES = 3
#: Tasks that merge each shard in the first of two rounds.
MERGERS = 8


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None where it is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE)
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
            out.append(None)
        else:
            out.append(key.lower())
    return out


def _hash128(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _probes(low: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, as rows."""
    step = mix(low) | np.uint64(1)
    return np.stack([(low + step * np.uint64(k)) & np.uint64(bits - 1) for k in range(PROBES)])


def _row_hashes(text: bytes, min_chars: int) -> set[bytes]:
    return {_hash128(k) for k in line_keys(text, min_chars) if k is not None}


def _low(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), np.dtype("<u8"))[::2].astype(np.uint64)


def _filters(batches: Iterator[pa.RecordBatch], min_chars: int, bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in slices(batches, "text"):
        hashes = [h for t in as_bytes(part.column(0)) for h in _row_hashes(t, min_chars)]
        if not hashes:
            continue
        # repeats within the slice count as seen twice, as np.unique shows
        low, n = np.unique(_low(hashes), return_counts=True)
        where = _probes(low, bits)
        byte, bit = (where >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (where & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
        known = (once[byte] & bit).astype(bool).all(axis=0) | (n > 1)
        np.bitwise_or.at(twice, byte[:, known].ravel(), bit[:, known].ravel())
        np.bitwise_or.at(once, byte.ravel(), bit.ravel())
    size, task = min(SHARD_BITS, bits) // 8, TaskContext.get().partitionId() % MERGERS
    for k in range(bits // 8 // size):
        part = slice(k * size, (k + 1) * size)
        if once[part].any():
            yield _shard(k, task, once[part], twice[part])


def _shard(shard: int, task: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "task": pa.array([task], pa.int32()), "once": pa.array([zlib.compress(once.tobytes(), 1)]), "twice": pa.array([zlib.compress(twice.tobytes(), 1)])})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (shard, once, twice) row for each shard met in this partition; at most one pair of filters is held."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for shard, _, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if shard not in held:
                held[shard] = [a.copy(), b.copy()]
                continue
            once, twice = held[shard]
            twice |= b | (once & a)
            once |= a
    for shard, (once, twice) in held.items():
        yield _shard(shard, 0, once, twice)


SHARDS = "shard int, task int, once binary, twice binary"


def bits_for(docs: DataFrame) -> int:
    """Bits of a filter for all lines of docs: a power of two, from 2^22 to FILTER_BITS."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    return min(FILTER_BITS, 1 << max(22, (size // BIT_BYTES).bit_length()))


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of hashes seen in more than one row: `bits` bits, whatever the input's size."""
    shards = max(1, bits // SHARD_BITS)
    made = docs.where(F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _filters(b, min_chars, bits), SHARDS)
    # two rounds, so that no task merges the filters of all others
    dealt = made.repartition(MERGERS * min(shards, 16), "shard", "task").mapInArrow(_merge, SHARDS)
    rows = dealt.repartition(min(shards, 16), "shard").mapInArrow(_merge, SHARDS).select("shard", "twice").toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    size = min(SHARD_BITS, bits) // 8
    for shard, twice in rows:
        out[shard * size : (shard + 1) * size] = np.frombuffer(zlib.decompress(bytes(twice)), np.uint8)
    return out


def _suspects(batches: Iterator[pa.RecordBatch], twice, min_chars: int, bits: int) -> Iterator[pa.RecordBatch]:
    seen = twice.value
    for part in slices(batches, "text"):
        ids, hashes = [], []
        for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            own = _row_hashes(text, min_chars)
            hashes.extend(own)
            ids.extend([doc_id] * len(own))
        if not hashes:
            continue
        where = _probes(_low(hashes), bits)
        hit = ((seen[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)
        if hit.any():
            words = np.frombuffer(b"".join(hashes), np.dtype("<i8")).reshape(-1, 2)[hit]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(ids, np.int64)[hit]), "h1": pa.array(words[:, 0]), "h2": pa.array(words[:, 1])})


def removals(docs: DataFrame, scratch: Scratch, min_chars: int = 20, min_docs: int = 3, bits: int | None = None) -> DataFrame:
    """(doc_id, h1, h2): the keys that each document loses. bits: of each filter, instead of as many as the texts ask for."""
    spark = docs.sparkSession
    bits = bits or bits_for(docs)
    twice = spark.sparkContext.broadcast(twice_filter(docs, min_chars, bits))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    suspects = texts.mapInArrow(lambda b: _suspects(b, twice, min_chars, bits), "doc_id long, h1 long, h2 long").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    held = scratch.cut(suspects.select("h1", "h2", "doc_id"), "suspects")
    confirmed = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that the join reads two plain shuffles and adaptive execution can split a frequent line's partition
    confirmed = scratch.cut(confirmed.select("h1", "h2", "keeper"), "confirmed")
    return held.join(confirmed, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "h1", "h2")


def _apply(batches: Iterator[pa.RecordBatch], schema: pa.Schema, min_chars: int, digest_only: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = as_bytes(part.column(part.schema.get_field_index("text")))
        lists = part.column(part.schema.get_field_index("gone__")).to_pylist()
        lines, dropped, kept = [], [], []
        for text, gone in zip(texts, lists, strict=True):
            lines.append(text.count(b"\n") + 1)
            if gone:
                bad = {h["h1"].to_bytes(8, "little", signed=True) + h["h2"].to_bytes(8, "little", signed=True) for h in gone}
                stay = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True) if key is None or _hash128(key) not in bad]
                dropped.append(lines[-1] - len(stay))
                text = b"\n".join(stay)
            else:
                dropped.append(0)
            kept.append(text)
        new = {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        if digest_only:
            new["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
        else:
            new["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        columns = [new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None, digest_only: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (or, digest_only, doc_id and kept_sha256 instead of the texts).

    New columns take the place of columns of the same names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lost = removals(docs, scratch, min_chars, min_docs, bits).groupBy(F.col("doc_id").alias("lost_id__")).agg(F.collect_list(F.struct("h1", "h2")).alias("gone__"))
    made = {"n_lines", "n_dropped", "kept_sha256" if digest_only else "kept_text"}
    columns = ["doc_id", "text"] if digest_only else [c for c in docs.columns if c not in made]
    base = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])
    out = StructType([f for f in base.schema if not digest_only or f.name != "text"]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256" if digest_only else "kept_text", "string")
    return apply_lists(base, lost, "gone__", lambda b, schema: _apply(b, schema, min_chars, digest_only), out, scratch)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_only=True)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.i, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
