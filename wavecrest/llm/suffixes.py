"""Sorting of fixed-length suffixes by a difference cover, for one bucket at a time.

`equal_windows` finds, among given positions of a text, those whose `length`-byte
strings occur at another given position. It is a ternary quicksort of the suffixes cut
at that length, vectorised over all groups of ties:

* A difference cover D modulo V=64 holds, for any two residues, a shift delta < 64 that
  takes both into D. The strings at cover positions (a sixth of all) are ranked
  beforehand: by their first 64 bytes, then by doubling with steps of 64, which stay
  inside the cover, to CORE bytes.
* Two suffixes are compared by their first 64 bytes; where these tie, the precomputed
  ranks at their common cover shift decide CORE further bytes at once, and the last
  bytes up to `length` are compared as words.

Memory is a fixed multiple of the bucket's bytes, however long the ties are.
"""

from __future__ import annotations

import numpy as np

V = 64


def difference_cover(v: int) -> np.ndarray:
    """Residues such that each difference modulo v is one of two of them, chosen greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = lambda r: len(missing & {(r - c) % v for c in cover} | missing & {(c - r) % v for c in cover})
        best = max(range(v), key=lambda r: (gain(r), -r))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover(V)
#: Residue -> its place in the cover, or -1.
PLACE = np.full(V, -1)
PLACE[COVER] = np.arange(len(COVER))
#: The least shift that takes both residues into the cover.
SHIFT = np.array([[next(s for s in range(V) if PLACE[(a + s) % V] >= 0 and PLACE[(b + s) % V] >= 0) for b in range(V)] for a in range(V)])


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, big-endian, so that they compare as the bytes do."""
    out = text[:-7].astype(np.uint64)
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= text[k : len(text) - 7 + k]
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, size: int, core: int) -> np.ndarray:
    """Ranks of the core-byte strings at all cover positions of a text of `size` bytes, in the order of positions."""
    blocks = size // V
    at = (np.arange(blocks)[:, None] * V + COVER).ravel()
    rank = {V: _dense(*(words[at + 8 * k] for k in range(V // 8)))}
    step, far = V, lambda r, n: np.concatenate([r[n // V * len(COVER) :], np.zeros(n // V * len(COVER), np.int64)])[: len(r)]
    while 2 * step <= core:
        rank[2 * step] = _dense(rank[step], far(rank[step], step))
        step *= 2
    done, out = step, rank[step]
    while done < core:
        part = max(s for s in rank if s <= core - done)
        out = _dense(out, far(rank[part], done))
        done += part
    return out


def equal_windows(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each position in `at` whether another one of its group begins with the same `length` bytes."""
    core = (length - V) // V * V
    size = -(-len(text) // V) * V
    padded = np.zeros(size + core + 2 * V, np.uint8)
    padded[: len(text)] = text
    words = words_at(padded)
    ranks = cover_ranks(words, size, core)
    ends = [V + core - V + k for k in range(0, length - core, 8)]
    ends[-1] = length - 8
    found = np.zeros(len(at), bool)
    order = np.argsort(group, kind="stable")
    label = group[order]
    while len(order):
        first = np.concatenate([[True], label[1:] != label[:-1]])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(order)))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.all():
            order, label = order[tied], label[tied]
            continue
        pivot = np.repeat(at[order[starts + sizes // 2]], sizes)
        own = at[order]
        sign = np.zeros(len(order), np.int8)
        open_ = np.flatnonzero(own != pivot)

        def decide(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal open_
            sign[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            open_ = open_[sign[open_] == 0]

        for k in range(0, V, 8):
            decide(words[own[open_] + k], words[pivot[open_] + k])
        a, b = own[open_], pivot[open_]
        shift = SHIFT[a % V, b % V]
        decide(*(ranks[(x + shift) // V * len(COVER) + PLACE[(x + shift) % V]] for x in (a, b)))
        for k in ends:
            decide(words[own[open_] + k], words[pivot[open_] + k])
        same = sign == 0
        count = np.add.reduceat(same.astype(np.int64), starts)
        found[order[same & np.repeat(count > 1, sizes)]] = True
        number = np.repeat(np.arange(len(starts)), sizes)
        key = 2 * number[~same] + (sign[~same] > 0)
        order = order[~same][np.argsort(key, kind="stable")]
        label = np.sort(key, kind="stable")
    return found
