"""Toxicity by a factorization machine over hashed terms, operator 3.

A text is the set of its hashed terms. Its score is the logistic function of
``bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` over the terms that were seen in
at least MIN_DOCS training texts, so that pairs of terms (an insult and whom it is aimed at)
weigh beyond what each adds. A term enters with a value x between 0 and 1 that says how
surely it tells the classes apart in the training rows (the absolute log odds ratio in
standard errors, up to TOP of them); terms below LEAST are left out, so that hundreds of
neutral words of a long text don't add up. Fitted by Adagrad on log loss, on a sample of
labelled rows whose bound is `labelled.SAMPLE_ROWS`; the model's size is fixed by
BUCKETS and FACTORS, so its broadcast is bounded. Scoring is one scan without a shuffle.

Defined cases: null and empty texts, and those with unseen terms only, get the bias,
that is about the share of toxic training rows. Without labels of both kinds the score
is that share (0 without any). Only texts enter a score. Rows without a doc_id are scored, are
never held out and carry no label; rows that repeat one are scored each, and one of them is
learnt from. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm import labelled
from wavecrest.llm._text import as_bytes, slices

FACTORS = 8
MIN_DOCS = 3
EPOCHS = 8
LEAST, TOP = 2.0, 6.0


@dataclass
class FactorizationMachine:
    bias: float
    slot: np.ndarray  # bucket -> row of w and v, or -1
    w: np.ndarray
    v: np.ndarray
    x: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        rows = [r[r >= 0] for r in (self.slot[s] for s in sets)]
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        if full := np.flatnonzero(sizes).tolist():
            flat = np.concatenate([rows[i] for i in full])
            out[full] += _raw(self.w, self.v, self.x, flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), sizes[full])[0]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _raw(w: np.ndarray, v: np.ndarray, x: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over each text; the pairwise part is divided by the set's size, so that long texts don't outweigh."""
    value = x[flat]
    own = v[flat] * value[:, None]
    total = np.add.reduceat(own, starts, axis=0)
    squares = np.add.reduceat((own * own).sum(1), starts)
    return np.add.reduceat(w[flat] * value, starts) + 0.5 * ((total * total).sum(1) - squares) / np.sqrt(sizes), total, own


def fit(labels: np.ndarray, sets: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 5e-3, batch: int = 128) -> FactorizationMachine:
    share = float(labels.mean()) if len(labels) else 0.0
    seen = np.bincount(np.concatenate(sets), minlength=labelled.BUCKETS) if sets else np.zeros(labelled.BUCKETS, int)
    hits = np.bincount(np.concatenate([s for s, y in zip(sets, labels, strict=True) if y] or [np.zeros(0, int)]), minlength=labelled.BUCKETS)
    n_1, n_0 = float(labels.sum()), float(len(labels) - labels.sum())
    surety = np.abs(np.log((hits + 0.5) / (n_1 + 1)) - np.log((seen - hits + 0.5) / (n_0 + 1))) / np.sqrt(1 / (hits + 0.5) + 1 / (seen - hits + 0.5))
    used = np.flatnonzero((seen >= MIN_DOCS) & (surety >= LEAST))
    x = np.minimum(surety[used] / TOP, 1.0)
    slot = np.full(labelled.BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    random = np.random.RandomState(11)
    w, v = np.zeros(len(used)), random.normal(0, 0.02, (len(used), FACTORS))
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    model = FactorizationMachine(bias, slot, w, v, x)
    if share in (0.0, 1.0):
        return model
    g_w, g_v, g_b = np.ones(len(used)), np.ones(v.shape), 1.0
    rows = [r[r >= 0] for r in (slot[s] for s in sets)]
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // batch)):
            part = [i for i in part if len(rows[i])]
            if not part:
                continue
            flat, sizes = np.concatenate([rows[i] for i in part]), np.array([len(rows[i]) for i in part])
            raw, total, own = _raw(w, v, x, flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            off = 1 / (1 + np.exp(-np.clip(raw + model.bias, -40, 40))) - labels[part]
            each, norm = np.repeat(off, sizes), np.repeat(1 / np.sqrt(sizes), sizes)
            ids, back = np.unique(flat, return_inverse=True)
            d_w = np.bincount(back, each * x[flat], len(ids)) + decay * w[ids]
            pair = (each * norm * x[flat])[:, None] * (np.repeat(total, sizes, axis=0) - own)
            d_v = np.stack([np.bincount(back, pair[:, k], len(ids)) for k in range(FACTORS)], axis=1) + decay * v[ids]
            g_w[ids] += d_w**2
            g_v[ids] += d_v**2
            w[ids] -= rate * d_w / np.sqrt(g_w[ids])
            v[ids] -= 0.1 * rate * d_v / np.sqrt(g_v[ids])
            d_b = float(off.sum())
            g_b += d_b**2
            model.bias -= 0.2 * rate * d_b / g_b**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, rows: int = labelled.SAMPLE_ROWS) -> FactorizationMachine:
    y, sets, _ = labelled.training_rows(docs, labelled.sample(labels, "toxic", eligible, rows))
    return fit(y, sets)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    machine, terms = model.value, labelled.Terms()
    for part in slices(batches, "text"):
        score = machine.scores([terms.of(t) for t in as_bytes(part.column(1))])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(score, 6))], names=["doc_id", "score"])


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score), one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: _score(b, sent), "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels, ~labelled.held_out(F.col("doc_id"))))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
