"""Features of texts, and bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.llm._text import WordHashes, as_bytes, mix, slices

#: The most labelled rows that a classifier is fitted on, whatever the size of the labels table.
SAMPLE_ROWS = 16_000
#: Hashed terms fall into so many buckets.
BUCKETS = 1 << 18
#: The most terms of one text that a fit looks at, those of smallest mixed bucket; with SAMPLE_ROWS it bounds what the driver holds.
TEXT_TERMS = 4096
EDGE = b"\"'`.,;:!?()[]{}<>*%$&#|/\\~^_=+-"

_CLASS = np.full(256, 7)
for _k, _chars in enumerate((b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*@^~|<>{}[]\\/_=+`")):
    _CLASS[list(_chars)] = _k
STYLE = 16


def style(text: bytes) -> np.ndarray:
    """STYLE numbers on how a text is written: shares of character classes, word and line shapes, repetition."""
    if not text:
        return np.zeros(STYLE)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=8)
    words = text.split()
    n, solid = len(words), max(1.0, len(text) - by_class[0])
    distinct = len(set(words))
    lines = text.count(b"\n") + 1
    letters = by_class[1] + by_class[2] + by_class[7]
    return np.array([
        1.0,
        letters / solid,
        by_class[2] / max(1.0, by_class[1] + by_class[2]),
        by_class[3] / solid,
        by_class[4] / solid,
        min(1.0, 5 * by_class[5] / solid),
        min(1.0, 5 * by_class[6] / solid),
        counts[ord("|")] / max(1, n),
        min(20.0, solid / max(1, n)) / 10,
        np.log1p(n) / 8,
        distinct / max(1, n),
        1.0 if n >= 20 and distinct < 0.1 * n else 0.0,
        np.log1p(len(text) / lines) / 8,
        min(1.0, (counts[ord(".")] + by_class[5]) * 5 / max(1, n)),
        1.0 if n < 5 else 0.0,
        by_class[7] / solid,
    ])


class Terms:
    """Distinct hashed terms of texts: words stripped of punctuation, A-Z lower-cased."""

    def __init__(self, limit: int = 300_000):
        self.bucket: dict[bytes, int] = {}
        self.limit, self.hashes = limit, WordHashes(seed=1)

    def of(self, text: bytes) -> np.ndarray:
        words = set(text.lower().split())
        if len(self.bucket) > self.limit:
            self.bucket.clear()
        bucket = self.bucket
        for w in words.difference(bucket):
            bucket[w] = self.hashes[w.strip(EDGE)] % BUCKETS
        return np.unique(np.fromiter(map(bucket.__getitem__, words), np.int32, len(words)))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether the remainder is 2; rows without an id are not held out (they can't be labelled either)."""
    return F.coalesce(crc_fold(doc_id) == 2, F.lit(False))


def sample(labels: DataFrame, target: str, eligible: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of at most about `rows` labelled ids, chosen by a hash of the id alone; contradicting labels count as the larger."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if eligible is not None:
        known = known.where(eligible)
    n = known.count()
    if n > 0.95 * rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * 0.95 * rows / n))
    return known.groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(F.col(target).cast("int")).alias("label"))


def _features(batches: Iterator[pa.RecordBatch], most_terms: int) -> Iterator[pa.RecordBatch]:
    of = Terms()
    for part in slices(batches, "text"):
        texts = as_bytes(part.column(2))
        sets = [of.of(t) for t in texts]
        few = [s if len(s) <= most_terms else s[np.sort(np.argsort(mix(s.astype(np.uint64)))[:most_terms])] for s in sets]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in few], pa.binary()), pa.array([style(t).tobytes() for t in texts], pa.binary())], names=["doc_id", "label", "terms", "style"])


def training_rows(docs: DataFrame, chosen: DataFrame, most_terms: int = TEXT_TERMS) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(labels, term sets, style rows) of the chosen ids, in an order that depends on the ids alone.

    Of rows that repeat an id one counts, chosen by a hash of what it holds, so at most as many rows
    return as ids were chosen, each of at most most_terms terms.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "text")
    made = joined.mapInArrow(lambda b: _features(b, most_terms), "doc_id long, label int, terms binary, style binary")
    one = F.min_by(F.struct("terms", "style"), F.struct(F.xxhash64("terms", "style"), "terms", "style"))
    rows = made.groupBy("doc_id").agg(F.max("label").alias("label"), one.alias("one")).select("doc_id", "label", "one.*").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    shapes = np.array([np.frombuffer(r["style"], np.float64) for r in rows]).reshape(len(rows), STYLE)
    return np.array([r["label"] for r in rows], np.float64), [np.frombuffer(r["terms"], np.int32) for r in rows], shapes
