"""Quality by hierarchical empirical Bayes, operator 8.

Evidence: a logistic regression gives each document the probability p of good quality, from
what is in the text (`Lexicon`: learnt weights of hashed terms, averaged over the text's
distinct terms) and how it is written (`labelled.style`, with squares). It is fitted on a
sample of labelled rows whose bound is `labelled.SAMPLE_ROWS`; the lexical numbers that the
regression is fitted on come from the other half of the sample, so terms can't vouch for
the rows they were learnt from.

Sites: documents belong to a host (`source`) and, below it, a path (`source` and
`lang`). Grouped aggregation over all documents gives counts and sums of p for paths
and hosts. A host's mean is shrunk towards the global mean, a path's towards its
host's, as much as the method of moments says: kappa, the within-site variance over
the variance between sites, is how many documents a parent weighs. A document's own p
is taken out of its sites' sums. Its posterior log odds are its own evidence plus the
log odds of its path against those of the training rows, so a sparse site hardly
moves a document and a rich site of mostly bad documents does.

Plan: one scan scores the texts and writes p with the wanted columns. Paths are
aggregated from it (pre-aggregated, one row for each path and task), and the written path
table joins it on plain columns; Spark broadcasts that below its own checked threshold and otherwise splits a hot site's
partition.

Defined cases: null and empty texts are scored by the features of an empty text. Null
hosts or paths form a site of their own. Without labels of both kinds p is the share
of good labelled rows (1 without any), so nothing is rejected for lack of labels.
Rows that repeat a doc_id or lack one are scored row by row; of the first one row is learnt
from, the second are never held out and carry no label. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wavecrest.llm import labelled
from wavecrest.llm._lists import shielded
from wavecrest.llm._scratch import Scratch
from wavecrest.llm._text import as_bytes, slices

#: Documents whose posterior falls below it are rejected.
KEEP_FROM = 0.5


#: Terms seen in fewer training texts have no weight.
MIN_DOCS = 3


@dataclass
class Lexicon:
    """bucket -> log odds of good against bad texts that hold the term, shrunk by its standard error; 0 for unseen ones."""

    weight: np.ndarray
    known: np.ndarray

    @classmethod
    def learn(cls, labels: np.ndarray, sets: list[np.ndarray]) -> Lexicon:
        count = lambda rows: np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=labelled.BUCKETS)
        seen, hits = count(sets), count([s for s, y in zip(sets, labels, strict=True) if y])
        n_1, n_0 = float(labels.sum()), float(len(labels) - labels.sum())
        odds = np.log((hits + 0.5) / (n_1 + 1)) - np.log((seen - hits + 0.5) / (n_0 + 1))
        error = 1 / (hits + 0.5) + 1 / (seen - hits + 0.5)
        known = seen >= MIN_DOCS
        return cls(np.where(known, odds * odds / (odds * odds + error + 1e-9) * odds, 0.0).astype(np.float32), known)

    def numbers(self, sets: list[np.ndarray]) -> np.ndarray:
        """Mean weight, mean size of the weights, and share of known terms, of each text."""
        out = np.zeros((len(sets), 3))
        for k, s in enumerate(sets):
            if len(s):
                w = self.weight[s]
                out[k] = w.sum() / (len(s) + 4), np.abs(w).sum() / (len(s) + 4), self.known[s].mean()
        return out


@dataclass
class Logistic:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float
    lexicon: Lexicon | None = None

    def of_features(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(_design((features - self.mean) / self.spread) @ self.weights, -30, 30)))

    def probabilities(self, texts: list[bytes], sets: list[np.ndarray]) -> np.ndarray:
        """Of each text, given with its set of terms."""
        if self.lexicon is None:
            return np.full(len(texts), self.prior)
        return self.of_features(np.concatenate([np.array([labelled.style(t) for t in texts]).reshape(len(texts), labelled.STYLE), self.lexicon.numbers(sets)], axis=1))


def _design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], axis=1)


def fit(labels: np.ndarray, features: np.ndarray, ridge: float = 0.3, steps: int = 30) -> Logistic:
    """Iteratively reweighted least squares with a ridge penalty."""
    share = float(labels.mean()) if len(labels) else 1.0
    if share in (0.0, 1.0):
        return Logistic(np.zeros(0), np.zeros(0), np.zeros(0), share)
    mean, spread = features.mean(0), features.std(0)
    spread = np.where(spread < 1e-9, 1.0, spread)
    x = _design((features - mean) / spread)
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return Logistic(mean, spread, w, share)


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, rows: int = labelled.SAMPLE_ROWS) -> Logistic:
    y, sets, shapes = labelled.training_rows(docs, labelled.sample(labels, "quality", eligible, rows))
    return learn(y, sets, shapes)


def learn(y: np.ndarray, sets: list[np.ndarray], shapes: np.ndarray) -> Logistic:
    half = np.arange(len(y)) % 2 == 1
    numbers = np.zeros((len(y), 3))
    for side in (half, ~half):
        other = Lexicon.learn(y[~side], [s for s, m in zip(sets, side, strict=True) if not m])
        numbers[side] = other.numbers([s for s, m in zip(sets, side, strict=True) if m])
    model = fit(y, np.concatenate([shapes, numbers], axis=1))
    model.lexicon = Lexicon.learn(y, sets) if len(model.weights) else None
    return model


def _evidence(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    terms = labelled.Terms()
    for part in slices(batches, "text"):
        texts = as_bytes(part.column(part.schema.get_field_index("text")))
        p = pa.array(np.clip(model.value.probabilities(texts, [terms.of(t) for t in texts]), 1e-6, 1 - 1e-6))
        yield pa.RecordBatch.from_arrays([p if f.name == "p__" else part.column(part.schema.get_field_index(f.name)) for f in schema], schema=schema)


def with_evidence(docs: DataFrame, model: Logistic, columns: list[str]) -> DataFrame:
    """The named columns of docs and p__."""
    from pyspark.sql.types import StructType

    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"]) if c != "text"], F.col("text").cast("string").alias("text"))
    out = StructType([base.schema[c] for c in columns]).add("p__", "double")
    arrow = to_arrow_schema(out)
    return base.mapInArrow(lambda b: _evidence(b, sent, arrow), out)


def _kappa(groups: DataFrame) -> float:
    """How many documents a parent's mean weighs, by moments over sites (columns n, s, q: count, sum, sum of squares)."""
    r = groups.agg(F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss")).first()
    if not r.n or r.sites < 2 or r.n <= r.sites:
        return 1e6
    within = max(r.q - r.ss, 0.0) / (r.n - r.sites)
    between = (r.ss - r.s * r.s / r.n - (r.sites - 1) * within) / (r.n - r.n2 / r.n)
    return float(np.clip(within / between, 1.0, 1e6)) if between > 0 else 1e6


@dataclass
class Sites:
    """Path and host sums, written, with the global mean and the two shrinkage weights."""

    table: DataFrame
    mean: float
    host_kappa: float
    path_kappa: float


def sites(scored: DataFrame, prior: float, host: str, path: str, scratch: Scratch) -> Sites:
    """scored: host, path and p__ of every document; prior: the mean where there are none."""
    sums = [F.count("*").alias("n"), F.sum("p__").alias("s"), F.sum(F.col("p__") * F.col("p__")).alias("q")]
    paths = scratch.cut(scored.groupBy(F.col(f"`{host}`").alias("host__"), F.col(f"`{path}`").alias("path__")).agg(*sums), "paths")
    hosts = scratch.cut(paths.groupBy("host__").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host__").eqNullSafe(F.col("h.host__")))
    both = both.select(F.col("p.host__").alias("host__"), F.col("p.path__").alias("path__"), F.col("p.n").alias("path_n__"), F.col("p.s").alias("path_s__"), F.col("h.n").alias("host_n__"), F.col("h.s").alias("host_s__"))
    return Sites(scratch.cut(both, "sites"), total[1] / total[0] if total[0] else prior, _kappa(hosts), _kappa(paths))


def posterior(scored: DataFrame, of: Sites, host: str, path: str, prior: float) -> DataFrame:
    """scored, with p__ replaced by posterior__."""
    p, eps = F.col("p__"), 1e-6
    odds = lambda x: F.log(F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps)) / (1 - F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps))))
    joined = scored.join(of.table, F.col(f"`{host}`").eqNullSafe(F.col("host__")) & F.col(f"`{path}`").eqNullSafe(F.col("path__")), "left")
    host_mean = (F.lit(of.mean) * of.host_kappa + F.col("host_s__") - p) / (F.col("host_n__") - 1 + of.host_kappa)
    path_mean = (host_mean * of.path_kappa + F.col("path_s__") - p) / (F.col("path_n__") - 1 + of.path_kappa)
    logit = odds(p) + odds(path_mean) - odds(F.lit(float(np.clip(prior, eps, 1 - eps))))
    return joined.withColumn("posterior__", 1 / (1 + F.exp(-logit))).drop("host__", "path__", "path_n__", "path_s__", "host_n__", "host_s__", "p__")


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", eligible: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (all by default) and posterior__."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels, eligible)
    names = shielded(docs, "doc_id", "text")
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    host, path, wanted = names[host], names[path], columns or docs.columns
    scored = scratch.cut(with_evidence(safe, model, list(dict.fromkeys([*(names[c] for c in wanted), host, path]))), "scored")
    table = sites(scored, model.prior, host, path, scratch)
    return posterior(scored, table, host, path, model.prior).select(*[F.col(names[c]).alias(c) for c in wanted], "posterior__")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, kept); as in operator 3, rows whose crc32(doc_id) modulo 4 is 2 are held out of the fit."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = labelled.held_out(F.col("doc_id"))
    scored = score(docs, labels, eligible=~held, columns=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), F.round("posterior__", 6).alias("score"), (F.col("posterior__") >= KEEP_FROM).alias("kept"))
