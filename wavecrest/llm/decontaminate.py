"""Benchmark decontamination by template canonicalisation, operator 10.

Words are runs of anything but white space, stripped of punctuation at both ends and
lower-cased. A word becomes a typed placeholder where it is a number, a unit of
measure, or a name (a capital inside a sentence). Windows of `width` words are hashed
as they are, with placeholders, and with placeholders for capitals that begin a sentence
too, as a name may stand there. A placeholder window counts only where at
least half of its words are literal and its slots are consistent: in one run of matched
windows along one alignment of document and item, equal slot values of the item stand for
equal values in the document (different ones may become equal). So a question whose numbers
or names were exchanged throughout is still found, and one that merely has a like shape is not.

A document is contaminated by an item when consecutive item words, covered by matched
windows, reach `run_words` (or the whole item where it is shorter). Items of fewer words than a
window are matched as one window of their own length. The words of an item shorter than
MIN_ITEM stand in many clean texts; it contaminates a document that has it as a whole line.

Plan: items become rows of (window hash, item, place); one scan of the documents makes rows of
(window hash, document, place, the window's words) for windows in a filter of bounded size, set by the
items' hashes, and the two join by hash. A window that very many documents hold is dealt in
parts. The matches of a document and an item meet in one task, sorted by alignment, which holds one alignment,
as long as the item, at a time. Texts don't shuffle; nothing of the benchmark is held whole
by the driver or in a broadcast, whatever its size.

Defined cases: null and empty texts match nothing; rows that repeat a doc_id or have none are
judged each by its own text, and rows equal in both give one result; a null item_id is an
item like others; an empty benchmark leaves all documents clean. Extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from wavecrest.llm._filter import NEED_BITS, chosen, dealt, filter_bits, hash_slot
from wavecrest.llm._lists import without
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import as_bytes, mix, slices

EDGE = b"\"'`.,;:!?()[]{}<>*%$&#|/\\~^_=+-"
NUMBER = re.compile(rb"\d[\d.,]*$")
QUANTITY = re.compile(rb"\d[\d.,]*[a-z\xc2\xb0\xc2\xb2\xc2\xb3]{1,4}$")
#: Number words and units of measure.
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset(b"mm cm dm m km mg g kg t ml cl dl l ms s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles ounce ounces pound pounds gallon gallons metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters dollar dollars cent cents euro euros percent degrees celsius fahrenheit mph kph watt watts volt volts joule joules newton newtons".split())
LITERAL, NUM, UNIT, NAME, BOTH = range(5)
SPECIAL = NUMBER_WORDS | UNITS
PLAIN = (LITERAL, LITERAL, 0, 1, 0)
SLOT = np.array([0, 0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD], np.uint64)
#: Shorter items count as whole lines only.
MIN_ITEM = 5
#: Kinds of windows: as they are, with placeholders, with names at the beginning of sentences too, whole lines.
PLAIN_WINDOW, TYPED, OPENED, LINE = range(4)
#: A word that stands for a line end.
LINE_END = b"\x00"


class Words:
    """Raw words by number: literal hash, kind inside a sentence and at its start, whether it ends one, and a line."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes, self.marks = np.empty(0, np.uint64), np.empty((0, 5), np.int8)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(literal hash, kind, kind with capitals that begin a sentence as names, line) of each word of the texts, end to
        end, and where each text ends. Lines are numbered through all texts."""
        if len(self.number) > self.limit:
            self.clear()
        number, words, ends = self.number, [], []
        for text in texts:
            words += text.replace(b"\n", b" \x00 ").split()
            ends.append(len(words))
        if new := list(set(words).difference(number)):
            known = len(self.hashes)
            number.update(zip(new, range(known, known + len(new)), strict=True))
            rows = [self.kind(w) for w in new]
            self.hashes = np.concatenate([self.hashes, np.fromiter((r[0] for r in rows), np.uint64, len(rows))])
            self.marks = np.concatenate([self.marks, np.array([r[1] for r in rows], np.int8)])
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ends = np.array(ends, np.int64)
        marks = self.marks[at]
        start = np.ones(len(words), bool)
        start[1:] = marks[:-1, 2] == 1
        start[ends[:-1][ends[:-1] < len(words)]] = True
        keep = marks[:, 3] == 1
        kind = np.where(start, marks[:, 1], marks[:, 0])[keep]
        line = np.cumsum(marks[:, 4])
        begins = np.zeros(len(words) + 1, np.int64)
        begins[ends] = 1
        line = line + np.cumsum(begins)[: len(words)]
        return self.hashes[at[keep]], kind, marks[keep, 0], line[keep], np.concatenate([[0], np.cumsum(keep)])[ends]

    @staticmethod
    def kind(word: bytes) -> tuple[int, tuple[int, int, int, int, int]]:
        """The literal hash, and: kind inside a sentence, kind at its start, whether it ends one, whether it is a word, whether it ends a line."""
        if word == LINE_END:
            return 0, (LITERAL, LITERAL, 1, 0, 1)
        if word.isalpha() and word.islower() and word not in SPECIAL:
            return xxhash.xxh3_64_intdigest(word), PLAIN
        core = word.strip(EDGE)
        if not core:
            return 0, (LITERAL, LITERAL, int(any(c in b".!?" for c in word)), 0, 0)
        low = core.lower()
        tail = word[len(word.rstrip(EDGE)) :]
        ends = int(bool(tail) and any(c in b".!?" for c in tail))
        inside = first = LITERAL
        if low in UNITS:
            inside = first = UNIT
        elif low in NUMBER_WORDS:
            inside = first = NUM
        elif 48 <= low[0] <= 57:
            if NUMBER.match(low):
                inside = first = NUM
            elif QUANTITY.match(low):
                inside = first = BOTH
        elif core[0] >= 0xC3 or 65 <= core[0] <= 90:
            text = core.decode("utf-8", "replace")
            if len(text) > 1 and text[0].isupper() and not text.isupper():
                inside = NAME
        return xxhash.xxh3_64_intdigest(low), (inside, first, ends, 1, 0)


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    if len(words) < width:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - width + 1, seed + width, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : len(words) - width + 1 + k]
        out ^= out >> np.uint64(31)
    return mix(out)


def _windows(literal: np.ndarray, kind: np.ndarray, named: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the literal windows, of those with placeholders (0 where they have none or too few literals), and of
    those in which capitals that begin a sentence are names too (0 where there are none)."""
    if len(literal) < width:
        return (np.empty(0, np.uint64),) * 3

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[width:] - total[: len(flags) - width + 1]

    plain = window_hashes(literal, width, 1)
    typed, opened = (window_hashes(np.where(k == LITERAL, literal, SLOT[k]), width, 2) for k in (kind, named))
    slots = count(kind != LITERAL)
    few = 2 * slots <= width
    return plain, np.where((slots > 0) & few, typed, 0), np.where((count(kind != named) > 0) & few, opened, 0)


def _line_hashes(literal: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash) of the lines of fewer than MIN_ITEM words."""
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(line)))
    first, size = first[size < MIN_ITEM], size[size < MIN_ITEM]
    out = np.zeros(len(first), np.uint64)
    for k in range(1, MIN_ITEM):
        at = np.flatnonzero(size == k)
        if len(at):
            out[at] = window_hashes(literal[first[at][:, None] + np.arange(k)].ravel(), k, 3)[::k]
    return first, size, out


WINDOW = "struct<h: bigint, there: int, w: int, typed: int>"
INDEX = f"item bigint, item_id bigint, literal binary, kind binary, named binary, windows array<{WINDOW}>"


def arrow_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _index(batches: Iterator[pa.RecordBatch], width: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The words of each item, and its windows."""
    words = Words()
    for part in slices(batches, "text"):
        rows = []
        for item, item_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
            literal, kind, named, _, _ = words.of([text])
            if not len(literal):
                continue
            w = min(width, len(literal))
            if len(literal) < MIN_ITEM:
                h = window_hashes(literal, w, 3)
                own = [(int(h[0]), 0, w, LINE)]
            else:
                own = [(int(h), place, w, typed) for typed, hashes in enumerate(_windows(literal, kind, named, w)) for place, h in enumerate(hashes) if h]
            own = [{"h": h - (h >> 63 << 64), "there": p, "w": w, "typed": t} for h, p, w, t in own]
            rows.append({"item": item, "item_id": item_id, "literal": literal.tobytes(), "kind": kind.tobytes(), "named": named.tobytes(), "windows": own})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


HITS = "h bigint, row bigint, doc_id bigint, place bigint, w int, typed int, words binary"


def _hits(batches: Iterator[pa.RecordBatch], widths: list[int], needed) -> Iterator[pa.RecordBatch]:
    """The windows of the documents whose hash is in the filter, with their words."""
    words, bits = Words(), needed.value
    inside = lambda h: (h != 0) & chosen((h & np.uint64(NEED_BITS - 1)).astype(np.int64), bits)
    for part in slices(batches, "text"):
        literal, kind, named, line, ends = words.of(as_bytes(part.column(2)))
        begins = np.concatenate([[0], ends[:-1]])
        owner = np.repeat(np.arange(part.num_rows), ends - begins)
        found = []
        for w in widths:
            for typed, hashes in enumerate(_windows(literal, kind, named, w)):
                at = np.flatnonzero(inside(hashes))
                at = at[owner[at] == owner[at + w - 1]]
                found.append((hashes[at], at, np.full(len(at), w), np.full(len(at), typed)))
        first, size, hashes = _line_hashes(literal, line)
        at = np.flatnonzero(inside(hashes))
        found.append((hashes[at], first[at], size[at], np.full(len(at), LINE)))
        h, at, w, typed = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(h):
            continue
        own = owner[at]
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(h.view(np.int64)),
            "row": part.column(0).take(pa.array(own)),
            "doc_id": part.column(1).take(pa.array(own)),
            "place": pa.array(at - begins[own]),
            "w": pa.array(w.astype(np.int32)),
            "typed": pa.array(typed.astype(np.int32)),
            "words": pa.array([literal[a : a + k].tobytes() for a, k in zip(at.tolist(), w.tolist(), strict=True)], pa.binary()),
        })


class Judged:
    """One document against one item: alignments come one after another."""

    def __init__(self, literal: bytes, kind: bytes, named: bytes):
        self.own, self.kind, self.named = np.frombuffer(literal, np.uint64), np.frombuffer(kind, np.int8), np.frombuffer(named, np.int8)
        self.covered, self.plain = np.zeros(len(self.own), bool), np.zeros(len(self.own), bool)

    def align(self, windows: list[tuple[int, int, int, bytes]]) -> None:
        """The matched windows (place in the item, width, kind, document words) of one alignment."""
        here, wider, values = np.zeros(len(self.own), bool), np.zeros(len(self.own), bool), np.zeros(len(self.own), np.uint64)
        for there, w, typed, words in windows:
            span = slice(there, there + w)
            values[span] = np.frombuffer(words, np.uint64)
            if typed == OPENED:
                # a capital that begins a sentence and stays the same is a literal word
                changed = (self.kind[span] != LITERAL) | (self.own[span] != values[span])
                wider[span] |= 2 * np.count_nonzero(changed & (self.named[span] != LITERAL)) <= w
                continue
            here[span] = True
            if typed != TYPED:
                self.plain[span] = True
        self.covered |= _consistent(here, self.own, self.kind, values)
        if wider.any():
            self.covered |= _consistent(here | wider, self.own, self.named, values)

    def result(self, run_words: int) -> tuple[int, int, str] | None:
        """(longest run of matched words, words of the item, how it was found) of a contaminating item."""
        run, n = _longest(self.covered | self.plain), len(self.own)
        return (run, n, "verbatim" if _longest(self.plain) == run else "template") if run >= min(run_words, n) else None


def _consistent(here: np.ndarray, own: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The words of those runs of matched words in which each slot value of the item has one value in the document."""
    out = np.zeros(len(own), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        slots = start + np.flatnonzero(kinds[start:stop] != LITERAL)
        pairs = set(zip(kinds[slots].tolist(), own[slots].tolist(), values[slots].tolist(), strict=True))
        out[start:stop] = len({p[:2] for p in pairs}) == len(pairs)
    return out


def _longest(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


FOUND = "row bigint, doc_id bigint, item_id bigint, matched_words bigint, item_words bigint, found_as string"


def _judge(batches: Iterator[pa.RecordBatch], run_words: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of (document, item) groups; rows come sorted by them, the item's own row first, then by alignment."""
    pair = judged = shift = None
    held: list[tuple[int, int, int, bytes]] = []
    out: list[tuple] = []

    def close() -> None:
        if judged is not None:
            if held:
                judged.align(held)
            if made := judged.result(run_words):
                out.append((pair[0], doc_id, item_id, *made))

    doc_id = item_id = None
    for batch in batches:
        for row, doc, item, number, place, there, w, typed, words, literal, kind, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row, item) != pair:
                close()
                pair, judged, doc_id, item_id, shift, held = (row, item), Judged(literal, kind, named), doc, number, None, []
                continue
            if place != shift:
                if held:
                    judged.align(held)
                shift, held = place, []
            held.append((there, w, typed, words))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)


JUDGE = ("row", "doc_id", "item", "item_id", "shift", "there", "w", "typed", "words", "literal", "kind", "named")


def _found(docs: DataFrame, items: DataFrame, width: int, run_words: int, scratch: Scratch) -> DataFrame:
    """FOUND rows, written; docs: (row, doc_id, text)."""
    spark = docs.sparkSession
    texts = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    of_index, of_found = arrow_of(INDEX), arrow_of(FOUND)
    index = scratch.cut(texts.mapInArrow(lambda b: _index(b, width, of_index), INDEX), "items")
    windows = scratch.cut(index.select("item", F.explode("windows").alias("x")).select("item", "x.*"), "windows")
    # window widths are few: those of the items from MIN_ITEM to `width` words
    widths = [r.w for r in windows.where(F.col("typed") != LINE).select("w").distinct().orderBy("w").collect()]
    needed = spark.sparkContext.broadcast(filter_bits(windows.select(F.col("h").alias("id")), hash_slot))
    hits = dealt(scratch.cut(docs.mapInArrow(lambda b: _hits(b, widths, needed), HITS), "hits"))
    wanted = hits.select("h", "part__").distinct().join(windows, "h").select("h", "part__", "item", "there", F.col("w").alias("item_w"), F.col("typed").alias("item_typed"))
    wanted = scratch.cut(wanted, "wanted")
    same = (F.col("w") == F.col("item_w")) & F.when(F.col("item_typed").isin(TYPED, OPENED), F.col("typed").isin(TYPED, OPENED)).otherwise(F.col("typed") == F.col("item_typed"))
    matches = hits.join(wanted, ["h", "part__"]).where(same)
    matches = matches.select("row", "doc_id", "item", (F.col("place") - F.col("there")).alias("shift"), "there", "w", F.greatest("typed", "item_typed").alias("typed"), "words")
    matches = scratch.cut(matches, "matches")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    heads = matches.select("row", "doc_id", "item").distinct().join(index.drop("windows"), "item").select("row", "doc_id", "item", "item_id", *none("long", "shift"), *none("int", "there", "w", "typed"), *none("binary", "words"), "literal", "kind", "named")
    rows = matches.select("row", "doc_id", "item", *none("long", "item_id"), "shift", "there", "w", "typed", "words", *none("binary", "literal", "kind", "named"))
    # the item's own row has a null shift, which sorts first
    both = heads.unionByName(rows).select(*JUDGE).repartition("row", "item").sortWithinPartitions("row", "item", "shift", "there")
    return scratch.cut(both.mapInArrow(lambda b: _judge(b, run_words, of_found), FOUND), "found")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 8, run_words: int = 13) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, found_as) for each contaminated document and item."""
    base = docs.select(F.xxhash64(F.col("doc_id"), F.col("text").cast("string")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(base, items, width, run_words, Scratch(docs.sparkSession, "leaks")).drop("row")


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = 8, run_words: int = 13) -> DataFrame:
    """docs without the contaminated documents; all columns stay as they are."""
    row = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    narrow = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _found(narrow, items, width, run_words, Scratch(docs.sparkSession, "leaks"))
    return without(docs.withColumn("text", F.col("text").cast("string")), found.select("row"), row)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
