"""Exact substring deduplication by blockwise suffix sorting, operator 2.

Every byte that lies in a `length`-byte string which also starts elsewhere, in another
document or the same one, is removed. Strings are judged on the input.

Method. Suffixes, cut at `length` bytes, are dealt into buckets by content, so that
equal ones always meet: of the KGRAM-byte strings inside a window of `length` bytes
the one with the least hash is its anchor, and the anchor's hash is the bucket. About
one position in 137 is an anchor; runs of neighbouring windows share one.

1. One scan lists each run: anchor hash, a 128-bit digest of all bytes its windows
   cover, and its place. Anchors that occur once end here; a window under such an anchor
   cannot occur twice.
2. Runs fold by digest, pre-aggregated: equal runs of two and more places are wholly
   repeated, and one of them stands for all from here on. Buckets with a single
   digest are done.
3. The bytes of the remaining runs, one for each digest, go to their buckets. A task
   takes buckets one after another, BUCKET_BYTES at a time, and sorts the cut suffixes
   of each by `suffixes.equal_windows`: ties beyond 64 bytes are resolved by ranks of a
   difference cover sample computed beforehand, so memory is a multiple of
   BUCKET_BYTES. Buckets of more than HOT different runs (a string that very many
   documents hold in different surroundings) are dealt further: each window, with the
   128-bit digest of its bytes, is a row, counted with pre-aggregation. A run or window that
   very many rows share is counted, and joined back, in parts.
4. The repeated intervals of each text, bounded by its own length, join the text.

Texts travel compressed, and only those with repeated anchors. A text is known by a
64-bit hash of its id and bytes, so rows that repeat a doc_id, and rows without one,
are each treated by their own text; equal rows repeat each other's strings.

Defined cases: null and empty texts have no bytes; texts shorter than `length` lose
nothing; bytes removed from inside a UTF-8 character are removed all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm._filter import chosen, dealt, filter_bits, id_slot
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import STEP, as_bytes, mix, slices
from wavecrest.llm.suffixes import equal_windows

KGRAM = 128
BUCKET_BYTES = 3 << 20
HOT = 3000
#: Texts are looked at in pieces of so many window starts; a place fits into 20 bits.
PIECE = 1 << 19

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (STEP, _INVERSE))
    return _POWERS[size]


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def anchors(data: np.ndarray, length: int, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor position of each window start, hash at each position); the leftmost of equal hashes counts."""
    h = kgram_hashes(data, k)
    low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - k + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64), h


def _runs_of(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, windows, anchor, hash) of the runs in texts laid end to end; bounds: their ends."""
    array = np.frombuffer(data, np.uint8)
    picked, h = anchors(array, length)
    starts = np.arange(len(picked))
    doc = np.searchsorted(bounds, starts, side="right")
    fine = starts + length <= bounds[doc]
    starts, doc, picked = starts[fine], doc[fine], picked[fine]
    if not len(starts):
        return (np.empty(0, np.int64),) * 5
    new = np.concatenate([[True], (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    return doc[at], starts[at], np.diff(np.append(at, len(starts))), picked[at], h[picked[at]]


def _runs(batches: Iterator[pa.RecordBatch], length: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", most_bytes=most):
        rows, texts = part.column(0).to_numpy(), as_bytes(part.column(1))
        if len(texts) == 1 and len(texts[0]) > most:
            pieces = [(texts[0][s : s + most + length - 1], np.array([min(most + length - 1, len(texts[0]) - s)]), s) for s in range(0, len(texts[0]), most)]
        else:
            pieces = [(b"".join(texts), np.cumsum([len(t) for t in texts]), 0)]
        for data, bounds, shift in pieces:
            if len(data) < length:
                continue
            doc, start, n, anchor, h = _runs_of(data, bounds, length)
            if not len(doc):
                continue
            digests = b"".join(xxhash.xxh3_128_digest(data[s : s + m + length - 1], int(a - s)) for s, m, a in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True))
            digests = np.frombuffer(digests, np.dtype("<i8")).reshape(-1, 2)
            begin = np.concatenate([[0], bounds[:-1]])[doc]
            place = ((start - begin + shift) << 20) | ((anchor - start) << 10) | n
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "r1": pa.array(digests[:, 0]), "r2": pa.array(digests[:, 1]), "row": pa.array(rows[doc]), "place": pa.array(place)})


def _pack(batches: Iterator[pa.RecordBatch], needed) -> Iterator[pa.RecordBatch]:
    """Size and digest of every text, and the compressed text where it may be needed."""
    press = zstandard.ZstdCompressor(level=1)
    for part in slices(batches, "text"):
        wanted = chosen(part.column(2).to_numpy(), needed.value)
        texts = as_bytes(part.column(3))
        yield pa.RecordBatch.from_pydict({
            "row": part.column(0),
            "doc_id": part.column(1),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "packed": pa.array([press.compress(t) if w else None for t, w in zip(texts, wanted, strict=True)], pa.binary()),
        })


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that a run's windows cover."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        if not batch.num_rows:
            continue
        out, last, text = [], None, b""
        for packed, place in zip(batch.column(batch.schema.get_field_index("packed")).to_pylist(), batch.column(batch.schema.get_field_index("place")).to_pylist(), strict=True):
            if packed != last:
                last, text = packed, unpack.decompress(packed)
            out.append(text[place >> 20 : (place >> 20) + (place & 1023) + length - 1])
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("h", "row", "place", "n")), pa.array(out, pa.binary())], names=["h", "row", "place", "n", "bytes"])


def _intervals(rows: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch | None:
    """Repeated windows as (row, start, stop), neighbours joined."""
    if not len(rows):
        return None
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length)])
    at = np.flatnonzero(new)
    stops = starts[np.append(at[1:], len(starts)) - 1] + length
    return pa.RecordBatch.from_pydict({"row": pa.array(rows[at]), "start": pa.array(starts[at]), "stop": pa.array(stops)})


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole buckets, as many at a time as BUCKET_BYTES hold; rows come sorted by bucket."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def work() -> pa.RecordBatch | None:
        h, row, place, n, data = zip(*held, strict=True)
        begin = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
        place = np.array(place, np.int64)
        count, anchor = place & 1023, (place >> 10) & 1023
        run = np.repeat(np.arange(len(data)), count)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        # windows of one bucket can be equal only where they lie alike to the anchor
        group = np.unique(np.array(h, np.int64), return_inverse=True)[1][run] * 1024 + anchor[run] - inner
        same = equal_windows(np.frombuffer(b"".join(data), np.uint8), begin[run] + inner, group, length)
        same &= np.array(n, np.int64)[run] == 1
        return _intervals(np.array(row, np.int64)[run[same]], (place >> 20)[run[same]] + inner[same], length)

    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BUCKET_BYTES and item[0] != held[-1][0]:
                if made := work():
                    yield made
                held, size = [], 0
            held.append(item)
            size += len(item[4])
    if held and (made := work()):
        yield made


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for _, row, place, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(place & 1023):
                digest = xxhash.xxh3_128_digest(data[k : k + length])
                out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), row, (place >> 20) + k, int(n > 1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["w1", "w2", "row", "start", "covered"])


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        doc_id, n_bytes, sha, packed, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes", "sha", "packed", "spans"))
        removed, runs, digest, kept = [], [], [], []
        for p, known, own in zip(packed.to_pylist(), sha.to_pylist(), spans, strict=True):
            if not own.is_valid:
                removed.append(0)
                runs.append(0)
                digest.append(known)
                kept.append(None)
                continue
            text = unpack.decompress(p)
            start, stop = (own.values.field(c).to_numpy() for c in ("start", "stop"))
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, stop, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        columns = {"doc_id": doc_id, "n_bytes": n_bytes, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            columns["kept_bytes"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def repeated(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Those of the written rows (with the column row) whose keys another row has too; a hot key is counted, and joined back, in parts."""
    rows = dealt(rows)
    by_part = scratch.cut(rows.groupBy(*keys, "part__").agg(F.count("*").alias("n__")), "parts")
    again = by_part.groupBy(*keys).agg(F.sum("n__").alias("n__")).where("n__ > 1").select(*keys)
    again = scratch.cut(by_part.join(again, keys).select(*keys, "part__"), "again")
    return rows.join(again, [*keys, "part__"])


def remove_substrings(docs: DataFrame, length: int = 400, with_text: bool = False, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    with_text: also kept_bytes, null where nothing was removed. piece: texts are looked at in pieces of so many window starts.
    """
    if not 2 * KGRAM <= length <= 1000:
        raise ValueError(f"length must be between {2 * KGRAM} and 1000")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    base = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = base.select("row", "text").mapInArrow(lambda b: _runs(b, length, piece), "h long, r1 long, r2 long, row long, place long")
    buckets = runs.groupBy("h").agg(F.count("*").alias("size"), F.min("r1").alias("low"), F.max("r1").alias("high")).where("size > 1")
    buckets = scratch.cut(buckets.select("h", (F.col("low") != F.col("high")).alias("mixed")), "buckets")
    suspects = scratch.cut(runs.join(buckets, "h"), "suspects")
    classes = suspects.groupBy("h", "r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"), F.first("mixed").alias("mixed"))
    classes = scratch.cut(classes.select("h", "r1", "r2", "n", "one.row", "one.place", "mixed"), "classes")
    places = lambda c: (F.shiftright(c, 20).alias("start"), (F.shiftright(c, 20) + c.bitwiseAND(F.lit(1023)) + (length - 1)).alias("stop"))
    equal_runs = repeated(suspects, ["h", "r1", "r2"], scratch).select("row", *places(F.col("place")))

    needed = spark.sparkContext.broadcast(filter_bits(suspects.select(F.col("row").alias("id"))))
    texts = base.select("row", "doc_id", id_slot(F.col("row")).alias("slot"), "text").mapInArrow(lambda b: _pack(b, needed), "row long, doc_id long, n_bytes long, sha string, packed binary")
    texts = scratch.cut(texts, "texts")

    mixed = classes.where("mixed").select("h", "row", "place", "n")
    hot = scratch.cut(mixed.groupBy("h").agg(F.count("*").alias("n_runs")).where(F.col("n_runs") > HOT).select("h"), "hot")
    bytes_of = texts.where("packed IS NOT NULL").select("row", "packed").dropDuplicates(["row"])
    cut_out = scratch.cut(mixed.join(bytes_of, "row").mapInArrow(lambda b: _cut_out(b, length), "h long, row long, place long, n long, bytes binary"), "bytes")
    sorted_buckets = cut_out.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _sort_buckets(b, length), "row long, start long, stop long")
    windows = cut_out.join(hot, "h").mapInArrow(lambda b: _window_rows(b, length), "w1 long, w2 long, row long, start long, covered long")
    windows = repeated(scratch.cut(windows, "windows"), ["w1", "w2"], scratch)
    hot_windows = windows.where("covered = 0").select("row", "start", (F.col("start") + length).alias("stop"))

    found = equal_runs.unionByName(sorted_buckets).unionByName(hot_windows).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    # texts without suspects need no join
    done = texts.where("packed IS NULL").withColumn("spans", F.lit(None).cast("array<struct<start:long,stop:long>>"))
    joined = texts.where("packed IS NOT NULL").join(found, "row", "left")
    both = done.select("doc_id", "n_bytes", "sha", "packed", "spans").unionByName(joined.select("doc_id", "n_bytes", "sha", "packed", "spans"))
    return scratch.result(both.mapInArrow(lambda b: _apply(b, with_text), out))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d)),
c AS (SELECT doc_id, i FROM p SEMI JOIN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) r USING (h)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s, a - 1 AS e FROM r UNION ALL
  SELECT d.doc_id, coalesce(max(z), 0) + 1, any_value(d.n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
t AS (SELECT k.doc_id, list(CASE WHEN e >= s THEN array_slice(b, s, e) ELSE encode('') END ORDER BY s) AS parts FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
q AS (SELECT doc_id, count(*) AS spans, sum(z - a + 1) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(list_reduce(parts, lambda x, y: x || y)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN q USING (doc_id)
"""
