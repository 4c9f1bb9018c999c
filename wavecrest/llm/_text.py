"""Vectorised hashing of words and bytes, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; it forgets all at `limit` words, which bounds memory."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; shorter texts give one hash of the whole sequence, empty ones none."""
    if not len(words):
        return words
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), len(words))], np.uint64)
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out *= STEP
        out += words[k : len(words) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the named text column holds about most_bytes; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, total + most_bytes, side="right"))
            stop = min(max(stop, start + 1), start + most_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
