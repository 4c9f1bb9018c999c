"""Removal of repeated passages by sliding sentence spans, operator 9.

A text is cut into sentences: after runs of . ! ? that white space follows, and after
line ends. Sentences are cut further into parts of at most PART words: of every PART
words in a row inside a sentence, after its first, the one with the smallest hash (of 32 bits, the
last of equal ones) begins a part. So a cut depends on no more than PART - 1 words to each side, and equal
passages are cut alike wherever they begin and end. A span is a run of at least
`sentences` consecutive parts with at least `words` words that loses one of the two
when its first or its last part goes: every such shortest run is hashed, with A-Z
lower-cased and white space made equal. Spans whose hash occurs more than once, in one
document or in several, are repeated. The occurrence in the smallest doc_id, and there
the first, stays; every part that another occurrence covers is removed. n_sentences and
n_removed count parts.

The cuts of two copies agree from the (2 PART - 2)nd word at the latest to as far from the
end, and no part has more than PART words; so every repeated passage of 4 PART + 12 = 48
words (with 15 words a span, and line ends alike) is found. Up to 16 words at its beginning and 17 at its end stay
where its first and last parts reach beyond it.

Plan: a first scan counts spans by the first 64 bits of their hash, pre-aggregated, and leaves a
filter of bounded size of those that occur again. A second scan writes (hash, document,
position) rows of the spans in the filter only; hashes are confirmed, and the occurrence that stays is chosen, by
aggregation over them, and the join back reads two plain shuffles, so that adaptive execution
splits a passage that a third of all documents hold. Each document's list of covered spans,
bounded by its own parts, then joins its text; texts that lose nothing don't shuffle
(`_lists`). Spans are known by 128 bits: two sums of the parts' hashes with different
multipliers, each mixed. At 10^13 spans two different ones agree with a chance of 10^-13.

Defined cases: null and empty texts have no parts and stay empty. Rows with a null
doc_id take no part and stay whole. Rows that repeat a doc_id count as one document:
all of them keep the first occurrence. Texts shorter than a span stay whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavecrest.llm._filter import NEED_BITS, chosen, filter_bits, hash_slot
from wavecrest.llm._lists import apply_lists
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import STEP, WordHashes, as_bytes, mix, slices

STOP = re.compile(rb"[.!?][\"')\]]*\Z")
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: No part has more words.
PART = 9
#: The two hashes of a span: a multiplier and a seed each.
STEPS = (STEP, np.uint64(0xA0761D6478BD642F))
SEEDS = (np.uint64(0), np.uint64(0xE7037ED1A0B428DB))
LENGTH = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.uint64(0xFFFFFFFF)
UPPER = ~LOWER


def _powers(step: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, step, np.uint64)]))


POWERS = tuple(_powers(step, PART) for step in STEPS)


class Marked(WordHashes):
    """Word hashes whose lowest bit says that the word ends a sentence."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = super().__missing__(word) & ~1 | (STOP.search(word) is not None)
        return out


def parts_of(texts: list[bytes], hashes: WordHashes, seeds: tuple[np.uint64, ...] = SEEDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end offset, words, two hashes) of the parts of all texts, and where each text's parts begin and the last one's end.

    Each part begins where the one before in its text ends.
    """
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    gap = np.concatenate([[True], SPACE[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    h = hashes.of(joined.lower().split())
    n, none = len(h), np.empty(0, np.int64)
    if not n:
        return none, none, np.empty((len(seeds), 0), np.uint64), np.zeros(len(texts) + 1, np.int64)
    stop = (h & np.uint64(1)) == 1
    lines = np.flatnonzero(raw == 10)
    before = np.searchsorted(starts, lines) - 1
    lines, before = lines[before >= 0], before[before >= 0]
    stop[before] = True
    ends[before] = lines + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    word = np.searchsorted(starts, begin)
    full = np.flatnonzero(np.diff(word))
    ends[word[full + 1] - 1] = begin[full] + sizes[full]
    stop[word[full + 1] - 1] = True
    if (windows := n - PART + 1) > 0:
        # the smallest hash (its upper half; the last of equal ones) of every PART words inside one sentence, after its first, begins a part
        least = (h & UPPER) | (LOWER - np.arange(n, dtype=np.uint64))
        width = 1
        while 2 * width <= PART:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: n - PART + 1], least[PART - width :]) if width < PART else least
        chosen_ = (LOWER - (least & LOWER)).astype(np.int64)
        sentence = np.cumsum(stop) - stop
        inside = sentence[:windows] == sentence[PART - 1 :]
        inside[0] = False
        inside[1:] &= ~stop[: windows - 1]
        stop[chosen_[inside] - 1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    words = last - first + 1
    place = np.arange(n) - np.repeat(first, words)
    own = np.stack([mix(np.add.reduceat(mix(h + seed) * power[place], first) + words.astype(np.uint64) * LENGTH) for seed, power in zip(seeds, POWERS, strict=False)])
    bounds = np.searchsorted(last, word)
    return ends[last] - np.repeat(begin[:-1], np.diff(bounds)), words, own, bounds


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end offset, words, two hashes) of each part; each begins where the one before ends."""
    return parts_of([text], Marked())[:3]


def runs(words: np.ndarray, bounds: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the shortest long enough runs from each first and to each last part, inside one text."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    begin, end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    last = np.maximum(np.searchsorted(total, total[:-1] + least_words, side="left") - 1, at + least_sentences - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1, at - least_sentences + 1)
    forward, backward = last < end, first >= begin
    both = np.concatenate([at[forward] * (n + 1) + last[forward], first[backward] * (n + 1) + at[backward]])
    both = np.unique(both)
    return both // (n + 1), both % (n + 1)


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two hashes of each run's sequence of part hashes, from prefix sums of a polynomial modulo 2^64."""
    return np.stack([run_hash(own, step, first, last) for own, step in zip(hashes, STEPS, strict=True)])


def run_hash(own: np.ndarray, step: np.uint64, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = len(own)
    power, back = _powers(step, n), _powers(np.uint64(pow(int(step), -1, 1 << 64)), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own) * power[:n])])
    # divided by the power of the first place, equal runs agree wherever they stand
    return mix((total[last + 1] - total[first]) * back[first] + (last - first + 1).astype(np.uint64) * LENGTH)


def _first_hashes(batches: Iterator[pa.RecordBatch], least_sentences: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """The first hash of every span."""
    marked = Marked()
    for part in slices(batches, "text"):
        _, words, own, bounds = parts_of(as_bytes(part.column(0)), marked, SEEDS[:1])
        first, last = runs(words, bounds, least_sentences, least_words)
        if len(first):
            yield pa.RecordBatch.from_pydict({"h1": pa.array(run_hash(own[0], STEPS[0], first, last).view(np.int64))})


def _spans(batches: Iterator[pa.RecordBatch], least_sentences: int, least_words: int, needed) -> Iterator[pa.RecordBatch]:
    """(h1, h2, document, place) of the spans whose first hash is in the filter."""
    marked, bits = Marked(), needed.value
    for part in slices(batches, "text"):
        _, words, own, bounds = parts_of(as_bytes(part.column(1)), marked)
        first, last = runs(words, bounds, least_sentences, least_words)
        if not len(first):
            continue
        h1 = run_hash(own[0], STEPS[0], first, last)
        hit = chosen((h1 & np.uint64(NEED_BITS - 1)).astype(np.int64), bits)
        if not hit.any():
            continue
        h1, first, last = h1[hit], first[hit], last[hit]
        h2 = run_hash(own[1], STEPS[1], first, last)
        owner = np.searchsorted(bounds, first, side="right") - 1
        # spans come in the order of their texts, which a stable sort keeps among equal hashes
        order = np.argsort(h1, kind="stable")
        again = np.zeros(len(first), np.int64)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        place = ((first - bounds[owner]) << 13) | ((last - first) << 1) | again
        yield pa.RecordBatch.from_pydict({"h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "doc_id": part.column(0).take(pa.array(owner)), "place": pa.array(place)})


def _apply(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest_only: bool) -> Iterator[pa.RecordBatch]:
    marked = Marked()
    for part in slices(batches, "text"):
        texts = as_bytes(part.column(part.schema.get_field_index("text")))
        all_ends, _, _, bounds = parts_of(texts, marked, SEEDS[:1])
        lists = part.column(part.schema.get_field_index("places__"))
        counts, removed, kept = [], [], []
        for t, (text, places) in enumerate(zip(texts, lists, strict=True)):
            ends = all_ends[bounds[t] : bounds[t + 1]]
            counts.append(len(ends))
            if not places.is_valid:
                removed.append(0)
                kept.append(text)
                continue
            place = places.values.to_numpy()
            first, last = place >> 13, (place >> 13) + ((place & 8191) >> 1)
            edge = np.zeros(len(ends) + 1, np.int64)
            # rows that repeat a doc_id may have other texts; places outside this one don't apply
            inside = last < len(ends)
            np.add.at(edge, first[inside], 1)
            np.add.at(edge, last[inside] + 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            starts = np.concatenate([[0], ends[:-1]])
            kept.append(b"".join(text[a:b] for a, b, g in zip(starts, ends, gone, strict=True) if not g) if len(ends) else text)
        new = {"n_sentences": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        if digest_only:
            new["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
        else:
            new["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 15, digest_only: bool = False) -> DataFrame:
    """docs with n_sentences, n_removed and kept_text (or, digest_only, doc_id and kept_sha256 instead of the texts).

    New columns take the place of columns of the same names.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(lambda b: _first_hashes(b, least_sentences, least_words), "h1 long").groupBy("h1").agg(F.count("*").alias("n"))
    needed = docs.sparkSession.sparkContext.broadcast(filter_bits(counts.where("n > 1").select(F.col("h1").alias("id")), hash_slot))
    spans = scratch.cut(texts.mapInArrow(lambda b: _spans(b, least_sentences, least_words, needed), "h1 long, h2 long, doc_id long, place long"), "spans")
    again = F.col("place").bitwiseAND(F.lit(1)).cast("long")
    repeated = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("most"), F.max(again).alias("again")).where("keeper <> most OR again = 1")
    repeated = scratch.cut(repeated.select("h1", "h2", "keeper"), "repeated")
    lost = spans.join(repeated, ["h1", "h2"]).where((F.col("doc_id") != F.col("keeper")) | (again == 1))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id__")).agg(F.collect_list("place").alias("places__"))
    made = {"n_sentences", "n_removed", "kept_sha256" if digest_only else "kept_text"}
    columns = ["doc_id", "text"] if digest_only else [c for c in docs.columns if c not in made]
    base = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])
    out = StructType([f for f in base.schema if not digest_only or f.name != "text"]).add("n_sentences", "long").add("n_removed", "long").add("kept_sha256" if digest_only else "kept_text", "string")
    return apply_lists(base, lost, "places__", lambda b, schema: _apply(b, schema, digest_only), out, scratch)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_only=True)
