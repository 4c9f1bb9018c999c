"""Scaling, label codes, and linear heads.

Fitting is one aggregation job for each step: sums and products of features are
gathered as partial sums over Arrow batches and reduced by Spark, so the driver holds
matrices of the feature width, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavecrest.operators.families import matrix, vectors

#: The two regularisation grids.
ALPHAS = np.logspace(-3, 3, 13)
WIDE_ALPHAS = np.logspace(-4, 4, 20)


# scaling


@dataclass
class Scaler:
    """Mean and population std; a column that hardly varies has scale 1."""

    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, std: np.ndarray) -> Scaler:
        return cls(mean, np.where(std <= 1e-12 * np.maximum(1, np.abs(mean)), 1.0, std))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


def column_moments(rows: DataFrame, column: str = "x") -> DataFrame:
    """(col, mean, std) of each element over rows; std is the population's."""
    return rows.select(F.posexplode(column).alias("col", "v")).groupBy("col").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def fit_scaler(rows: DataFrame, column: str = "x") -> Scaler:
    """Two passes over partial sums; equal to column_moments without a row for each element."""
    n, first = _sums(rows, column, None)
    mean = first[0] / n
    _, second = _sums(rows, column, mean)
    return Scaler.of(mean, np.sqrt(second[1] / n))


def _sums(rows: DataFrame, column: str, centre: np.ndarray | None) -> tuple[int, np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                x = x if centre is None else x - centre
                part = np.stack([x.sum(0), (x * x).sum(0)])
                n, out = n + len(x), part if out is None else out + part
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "sums": vectors(out.reshape(1, -1))})

    total = _reduce(rows.select(column).mapInArrow(work, "n long, sums array<double>"), "sums")
    return total[0], total[1].reshape(2, -1)


def _reduce(parts: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Sums arrays of partial results in rounds, so that no task adds up those of all others.

    The first round has as many tasks as the session's shuffles, the next their root, so that with S
    shuffle partitions and P partial results no task adds more than about max(P / S, root of S) arrays.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if batch.num_rows:
                n += int(np.sum(batch.column(0).to_numpy()))
                part = matrix(batch.column(1)).sum(0)
                out = part if out is None else out + part
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), column: vectors(out.reshape(1, -1))})

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = parts
    for size in dict.fromkeys([tasks, math.isqrt(tasks) if tasks > 64 else 1, 1]):
        rounds = rounds.repartition(size).mapInArrow(add, parts.schema)
    row = rounds.first()
    if row is None:
        raise ValueError("there are no rows to fit on")
    return row[0], np.array(row[1])


def scaled(rows: DataFrame, scaler: Scaler, column: str = "x", output: str = "z", keep: Sequence[str] = ("series_id",), scrub: bool = False) -> DataFrame:
    """(keep, output); scrub: what isn't finite after scaling becomes 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = scaler.apply(matrix(batch.column(batch.num_columns - 1)))
                z = np.where(np.isfinite(z), z, 0.0) if scrub else z
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors(z)], names=[*keep, output])

    source = rows.select(*keep, column)
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{fields}{output} array<double>")


# labels


def label_codes(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): 0.. by sorted training label."""
    known = train.select(label).where(F.col(label).isNotNull()).distinct()
    # one row for each class: classes are few by nature
    return known.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("code"))


def encode(rows: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    """rows with code; labels that training never had get -1."""
    return rows.join(codes, label, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def encode_strict(rows: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    """As encode, but an unknown label is an error."""
    joined = rows.join(codes, label, "left")
    return joined.withColumn("code", F.coalesce("code", F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")))


# ridge


@dataclass
class Ridge:
    """Centred ridge regression on one or more targets."""

    alpha: float
    mean: np.ndarray
    target_mean: np.ndarray
    weights: np.ndarray  # (features, targets)

    def decide(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights + self.target_mean


def targets(codes: np.ndarray, classes: int) -> np.ndarray:
    """One column of -1 and 1 for each class; one column in all for two classes."""
    out = np.where(codes[:, None] == np.arange(classes), 1.0, -1.0)
    return out[:, 1:] if classes == 2 else out


def _labelled(rows: DataFrame, features: str, code: str) -> DataFrame:
    """(features, code) of the rows whose label is known; code -1 teaches nothing."""
    return rows.where(F.col(code) >= 0).select(features, F.col(code).cast("int"))


def _gram(rows: DataFrame, features: str, code: str, classes: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, mean of features, mean of targets, centred F'F and F'Y, from partial sums; rows with code -1 or null are left out."""
    outputs = 1 if classes == 2 else classes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                wide = np.concatenate([x, targets(batch.column(1).to_numpy(), classes), np.ones((len(x), 1))], axis=1)
                part = wide.T @ wide
                n, out = n + len(x), part if out is None else out + part
        if n:
            # the upper triangle says it all
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "sums": vectors(out[np.triu_indices(len(out))].reshape(1, -1))})

    n, flat = _reduce(_labelled(rows, features, code).mapInArrow(work, "n long, sums array<double>"), "sums")
    m = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = flat
    full = full + np.triu(full, 1).T
    p = m - 1 - outputs
    mean, y_mean = full[:p, -1] / n, full[p : p + outputs, -1] / n
    return n, mean, y_mean, full[:p, :p] - n * np.outer(mean, mean), full[:p, p : p + outputs] - n * np.outer(mean, y_mean)


def ridge_at(rows: DataFrame, classes: int, alpha: float = 1.0, features: str = "z", code: str = "code") -> Ridge:
    _, mean, y_mean, gram, cross = _gram(rows, features, code, classes)
    return Ridge(alpha, mean, y_mean, np.linalg.solve(gram + alpha * np.eye(len(gram)), cross))


def ridge_cv(rows: DataFrame, classes: int, alphas: Sequence[float] = ALPHAS, features: str = "z", code: str = "code") -> tuple[Ridge, dict[float, float]]:
    """Ridge with the alpha of least mean squared leave-one-out residual (the first of equal ones), and all errors.

    The Gram matrix gives all solutions by one eigendecomposition. A second pass over the rows
    finds each row's residual and leverage for every alpha where it lies; only sums of squares
    return, so rows never meet on the driver.
    """
    n, mean, y_mean, gram, cross = _gram(rows, features, code, classes)
    size, basis = np.linalg.eigh(gram)
    size = np.maximum(size, 0)
    turned = basis.T @ cross
    inverse = 1 / (size[None, :] + np.asarray(alphas, float)[:, None])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out = 0, np.zeros(len(alphas))
        for batch in batches:
            if batch.num_rows:
                x = (matrix(batch.column(0)) - mean) @ basis
                y = targets(batch.column(1).to_numpy(), classes) - y_mean
                count += len(x)
                for k, inv in enumerate(inverse):
                    leverage = 1 / n + (x * x) @ inv
                    rest = (y - (x * inv) @ turned) / np.maximum(1 - leverage, 1e-12)[:, None]
                    out[k] += (rest * rest).sum()
        if count:
            yield pa.RecordBatch.from_pydict({"n": pa.array([count]), "sums": vectors(out.reshape(1, -1))})

    _, errors = _reduce(_labelled(rows, features, code).mapInArrow(work, "n long, sums array<double>"), "sums")
    errors = errors / (n * turned.shape[1])
    best = int(np.argmin(errors))
    weights = basis @ (inverse[best][:, None] * turned)
    return Ridge(float(alphas[best]), mean, y_mean, weights), dict(zip(map(float, alphas), errors.tolist(), strict=True))


def ridge_dual_cv(x: np.ndarray, y: np.ndarray, alphas: Sequence[float] = ALPHAS) -> tuple[float, np.ndarray]:
    """The same choice from the n by n Gram matrix, for few rows with very many features; returns alpha and errors."""
    n = len(x)
    c = x - x.mean(0)
    size, basis = np.linalg.eigh(c @ c.T)
    size = np.maximum(size, 0)
    rest = y - y.mean(0)
    turned, errors = basis.T @ rest, []
    for a in alphas:
        shrink = size / (size + a)
        leverage = 1 / n + (basis * basis) @ shrink
        errors.append((((rest - basis @ (shrink[:, None] * turned)) / (1 - leverage)[:, None]) ** 2).mean())
    return float(alphas[int(np.argmin(errors))]), np.array(errors)


def predict(rows: DataFrame, model: Ridge, features: str = "z", keep: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keep, prediction): the class of largest decision value, the first of equal ones; by sign for two classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = model.decide(matrix(batch.column(batch.num_columns - 1)))
                made = (d[:, 0] > 0).astype(np.int32) if d.shape[1] == 1 else d.argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*keep, "prediction"])

    source = rows.select(*keep, features)
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{fields}prediction int")


def accuracy(predicted: DataFrame, code: str = "code", prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg((F.col(code) == F.col(prediction)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def classify(train: DataFrame, test: DataFrame, features: str, label: str = "label", key: str = "series_id", alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """End to end: scaler and ridge fitted on train; one row with test accuracy, width, alpha and class count.

    Rows without a label neither teach nor count; test labels that training never had count as wrong.
    """
    spark = train.sparkSession
    train, test = (part.where(F.col(label).isNotNull()) for part in (train, test))
    codes = collected(label_codes(train, label))
    scaler = fit_scaler(train, features)
    fitted = scaled(encode(train, codes, label), scaler, features, "z", (key, "code"), scrub=True).persist()
    classes = codes.count()
    try:
        model, _ = ridge_cv(fitted, classes, alphas)
    finally:
        fitted.unpersist()
    held = scaled(encode(test, codes, label), scaler, features, "z", (key, "code"), scrub=True)
    row = accuracy(predict(held, model, keep=(key, "code"))).first()
    return spark.createDataFrame([(row.accuracy, row.n, len(scaler.mean), model.alpha, classes)], "accuracy double, n_test long, n_features int, alpha double, n_classes int")


def collected(codes: DataFrame) -> DataFrame:
    """The label codes as a small table of their own, not computed again: one row for each class."""
    return codes.sparkSession.createDataFrame(codes.collect(), codes.schema)


# regression between blocks, and gradient-boosted or logistic heads


def block_sums(rows: DataFrame, columns: Sequence[str], function, width: int) -> tuple[int, np.ndarray]:
    """Rows and the sum over batches of function(matrices of the columns), flattened to `width` numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                n, out = n + batch.num_rows, out + np.asarray(function(*(matrix(c) for c in batch.columns)), float).ravel()
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "sums": vectors(out.reshape(1, -1))})

    return _reduce(rows.select(*columns).mapInArrow(work, "n long, sums array<double>"), "sums")


def unexplained_variance(train: DataFrame, test: DataFrame, source: str = "a", target: str = "b", alpha: float = 1.0) -> float:
    """Share of the target block's test variance (about its training mean) that a ridge from the source block leaves."""
    first = train.select(F.size(source), F.size(target)).first()
    if first is None:
        raise ValueError("there are no rows to fit on")
    p, q = first

    def joint(a, b):
        wide = np.concatenate([a, b, np.ones((len(a), 1))], axis=1)
        return wide.T @ wide

    n, flat = block_sums(train, (source, target), joint, (p + q + 1) ** 2)
    full = flat.reshape(p + q + 1, -1)
    mean = full[:-1, -1] / n
    centred = full[:-1, :-1] - n * np.outer(mean, mean)
    weights = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p:])

    def left(a, b):
        about = b - mean[p:]
        return ((about - (a - mean[:p]) @ weights) ** 2).sum(), (about**2).sum()

    _, (rest, total) = block_sums(test, (source, target), left, 2)
    return float(rest / total)


def spectrum_ranks(rows: DataFrame, column: str = "x") -> tuple[float, float]:
    """Participation ratio and entropy rank of the centred rows, from the eigenvalues of their Gram matrix."""
    width = rows.select(F.size(column)).first()[0]
    _, mean = block_sums(rows, (column,), lambda x: x.sum(0), width)
    n = rows.count()
    _, flat = block_sums(rows, (column,), lambda x: (x - mean / n).T @ (x - mean / n), width * width)
    size = np.maximum(np.linalg.eigvalsh(flat.reshape(width, width)), 0)
    s = np.sqrt(size[size > 1e-12 * size.max()])
    share = s / s.sum()
    return float(size.sum() ** 2 / (size**2).sum()), float(np.exp(-(share * np.log(share)).sum()))


def spanned_control(x: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A fixed random mixture of a block's own columns, as wide as the block it is compared with."""
    return x @ (np.random.RandomState(seed).randn(x.shape[1], width) / np.sqrt(x.shape[1]))


def logistic_head(train: DataFrame, features: str = "z", code: str = "code"):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    return LogisticRegression(featuresCol="v", labelCol=code, maxIter=50, regParam=1e-3).fit(train.select(array_to_vector(features).alias("v"), F.col(code).cast("double").alias(code)))


def boosted_head(train: DataFrame, features: str = "z", code: str = "code", rounds: int = 300):
    """Gradient-boosted trees, one against the rest, without looking at the test rows; all rounds, none stopped early."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(features).alias("v"), F.col(code).cast("double").alias(code))
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, stepSize=0.05, seed=7), featuresCol="v", labelCol=code).fit(rows)


def decision(column: Column, weights: np.ndarray, bias: float) -> Column:
    """A linear decision as a column expression, for narrow models."""
    from wavecrest.functions.columns import dot, literal

    return dot(column, literal(weights)) + F.lit(float(bias))
