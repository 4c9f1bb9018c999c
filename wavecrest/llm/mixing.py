"""Mixing documents to target domain weights, operator 4.

Domains are soft. Two classifiers fitted on the labels table (style for quality, the
factorization machine for toxicity) give each document posteriors p of the domains
junk (quality 0), toxic (quality 1, toxic 1) and clean (the rest). A document's rate
r >= 0 says how often it is to be drawn; the expected tokens of domain k are
sum_d r_d * n_d * p_dk. Rates start at 1 and follow projected gradient steps for the
least squares of expected tokens against targets:

    r_d <- max(0, y_d - p_d . g),   g = M^-1 (expected at y - target),   M = sum_d n_d p_d p_d'

which is a unit gradient step for the norm M^-1 in the variables sqrt(n_d) r_d, where its
largest curvature is 1; y is r with Nesterov's momentum. A step is one sum of six
numbers over all documents: a document's rate follows from its own posteriors and the
vectors g so far, so no state is shuffled or stored between steps. Steps end when all
totals are within `tolerance` of the target (as a share of all tokens), when they no
longer change, or after `steps`.

The rate takes effect as `draws`, the whole number of copies that a mixture takes of a document.

Defined cases: null and empty texts have no tokens; they keep the rate that their
posteriors give them. Targets for domains that no text belongs to can't be met: the
least-squares rates are returned. An empty table gives no rows. Rows that repeat a
doc_id or lack one have rates of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wavecrest.llm import labelled, quality, toxicity
from wavecrest.llm._lists import shielded
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import as_bytes, slices

DOMAINS = ("clean", "toxic", "junk")
#: Shares of the tokens that are wanted from each domain.
TARGETS = {"clean": 0.95, "toxic": 0.05, "junk": 0.0}


def _posteriors(batches: Iterator[pa.RecordBatch], models, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    good, machine = models.value
    terms = labelled.Terms()
    for part in slices(batches, "text"):
        texts = as_bytes(part.column(part.schema.get_field_index("text")))
        sets = [terms.of(t) for t in texts]
        p_good, p_toxic = good.probabilities(texts, sets), machine.scores(sets)
        new = {"n_tokens": pa.array([len(t.split()) for t in texts], pa.int64())}
        new |= {f"p_{d}": pa.array(np.round(p, 6)) for d, p in zip(DOMAINS, (p_good * (1 - p_toxic), p_good * p_toxic, 1 - p_good), strict=True)}
        yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)) for f in schema], schema=schema)


MADE = ("n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "draws")


def posteriors(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, and n_tokens, p_clean, p_toxic, p_junk, of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((quality.train(docs, labels, eligible), toxicity.train(docs, labels, eligible)))
    kept = [c for c in columns if c not in MADE]
    base = docs.select(*[F.col(f"`{c}`") for c in kept if c != "text"], F.col("text").cast("string").alias("text"))
    out = StructType([base.schema[c] for c in kept]).add("n_tokens", "long")
    for d in DOMAINS:
        out = out.add(f"p_{d}", "double")
    arrow = to_arrow_schema(out)
    return base.mapInArrow(lambda b: _posteriors(b, sent, arrow), out)


def _replay(p: np.ndarray, path: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, rates with momentum) after the steps in path."""
    rate = ahead = np.ones(len(p))
    for g, momentum in path:
        before, rate = rate, np.maximum(0, ahead - p @ g)
        ahead = rate + momentum * (rate - before)
    return rate, ahead


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    return batch.column(at("n_tokens")).to_numpy().astype(float), np.stack([batch.column(at(f"p_{d}")).to_numpy() for d in DOMAINS], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], path: list[tuple[np.ndarray, float]], first: bool) -> Iterator[pa.RecordBatch]:
    """Of one partition: expected tokens by rate and with momentum; at first tokens and M instead."""
    total = np.zeros(1 + len(DOMAINS) ** 2 if first else 2 * len(DOMAINS))
    for batch in batches:
        n, p = _columns(batch)
        if first:
            total += np.concatenate([[n.sum()], (p.T @ (p * n[:, None])).ravel()])
        else:
            total += np.concatenate([(n * r) @ p for r in _replay(p, path)])
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{k}" for k in range(len(total))])


def _with_rate(batches: Iterator[pa.RecordBatch], path: list[tuple[np.ndarray, float]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rate = np.round(_replay(_columns(batch)[1], path)[0], 5)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], schema=schema)


def rates(table: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, steps: int = 40, tolerance: float = 1e-3) -> DataFrame:
    """table (as posteriors() makes it, written) with the column rate. budget: wanted tokens as a share of all."""
    k = len(DOMAINS)
    needed = table.select("n_tokens", *[f"p_{d}" for d in DOMAINS])

    def gather(path: list, first: bool = False) -> np.ndarray:
        names = [f"s{i}" for i in range(1 + k * k if first else 2 * k)]
        sums = needed.mapInArrow(lambda b: _sums(b, path, first), ", ".join(f"{c} double" for c in names))
        return np.array([float(v or 0.0) for v in sums.agg(*[F.sum(c) for c in names]).first()])

    total, *gram = gather([], first=True)
    weights = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = weights / weights.sum() * total * budget
    inverse = np.linalg.pinv(np.array(gram).reshape(k, k), rcond=1e-10, hermitian=True)
    path, pace, last, before = [], 1.0, np.inf, None
    for _ in range(steps if total else 0):
        by_rate, ahead = np.split(gather(path), 2)
        done = before is not None and np.abs(by_rate - before).max() <= 1e-7 * total
        if done or np.abs(by_rate - wanted).max() <= tolerance * total:
            break
        before, off = by_rate, ahead - wanted
        size = off @ inverse @ off
        if size > last:  # momentum overshot
            pace = 1.0
        last, quicker = size, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        path = [*path, (inverse @ off, (pace - 1) / quicker)]
        pace = quicker
    out = StructType(list(table.schema.fields)).add("rate", "double")
    arrow = to_arrow_schema(out)
    return table.mapInArrow(lambda b: _with_rate(b, path, arrow), out)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, eligible: Column | None = None, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, n_tokens, p_clean, p_toxic, p_junk, rate and draws; own columns take the place of equal names."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names = shielded(docs, "doc_id", "text")
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = [c for c in columns if c not in MADE]
    rated = rates(scratch.cut(posteriors(safe, labels, eligible, [names[c] for c in kept]), "posteriors"), targets, budget)
    rated = rated.withColumn("draws", draws(rated))
    return rated.select(*[F.col(names[c]).alias(c) for c in kept], *MADE)


def draws(rated: DataFrame) -> Column:
    """The rate rounded to a whole number of copies, up or down by a hash of the row, so that copies mean as many as rates."""
    chance = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in rated.schema if f.name != "rate" and f.dataType.typeName() != "map"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(F.col("rate") + chance).cast("int")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
