"""Fit, transform, predict and score on frames of (series_id, x, label).

The dictionary needs series of one length, and says so otherwise. Without it (words=0) series may have any
lengths, or be arrays of channels. Rows without a label neither teach nor count.

    model = SeriesClassifier().fit(train)
    model.score(test)

`SeriesFeatures` holds what fitting learns before the head: dictionary biases and the
embedding's scaler. Its transform is one narrow stage: dictionary, embedding, scaling
and battery of a series are computed where its row lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions.banks import load_banks
from wavecrest.operators import battery, dictionary, embedding, fourspace, heads


def from_matrix(spark: SparkSession, x: np.ndarray, labels: Sequence | None = None, scrub: bool = False) -> DataFrame:
    """A frame of the rows of a matrix, for small inputs at hand; (n, 1, T) arrays lose their channel axis. scrub: NaN and infinities as finite numbers."""
    x = np.asarray(x, float)
    x = x[:, 0] if x.ndim == 3 else x
    x = np.nan_to_num(x) if scrub else x
    rows = [(i, row.tolist(), None if labels is None else labels[i]) for i, row in enumerate(x)]
    kind = "string" if labels is not None and any(isinstance(v, str) for v in labels) else "int"
    return spark.createDataFrame([(i, v, t if t is None or kind == "string" else int(t)) for i, v, t in rows], f"series_id long, x array<double>, label {kind}")


@dataclass
class SeriesFeatures:
    """words: dictionary columns (0 for none). pooling: full or pruned. expand: whether the battery is appended."""

    words: int = 1512
    pooling: str = "full"
    expand: bool = True
    banks: dict | str | None = None
    rocket: dictionary.MiniRocket | None = field(default=None, repr=False)
    scaler: heads.Scaler | None = field(default=None, repr=False)

    def fit(self, train: DataFrame, column: str = "x") -> SeriesFeatures:
        self.rocket = dictionary.fit(train, self.words, column) if self.words else None
        self.scaler = heads.fit_scaler(embedding.embed(train, self.pooling, column, banks=self.banks).where("embedding IS NOT NULL"), "embedding")
        return self

    def transform(self, rows: DataFrame, column: str = "x", keep: Sequence[str] = ("series_id",)) -> DataFrame:
        """(keep, values); empty series give no row."""
        if self.scaler is None:
            raise ValueError("fit comes first")
        if not self.rocket:
            embedded = embedding.embed(rows, self.pooling, column, keep=[k for k in keep if k != "series_id"], banks=self.banks).where("embedding IS NOT NULL")
            z = heads.scaled(embedded, self.scaler, "embedding", "values", keep)
            return battery.with_battery(z, "values", output="values", keep=keep, append=True) if self.expand else z
        rocket, scaler, pooling, expand, banks = self.rocket, self.scaler, self.pooling, self.expand, load_banks(self.banks)

        def make(x: np.ndarray) -> np.ndarray:
            z = scaler.apply(embedding.embed_matrix(x, pooling, banks))
            return np.concatenate([np.nan_to_num(rocket.features(x)), z, *([battery.battery(z)] if expand else [])], axis=1)

        return fourspace.over_series(rows, make, column, keep, rows=64)


@dataclass
class SeriesClassifier:
    features: SeriesFeatures = field(default_factory=SeriesFeatures)
    alphas: Sequence[float] = tuple(heads.ALPHAS)
    head: heads.Ridge | None = field(default=None, repr=False)
    errors: dict[float, float] | None = field(default=None, repr=False)

    def fit(self, train: DataFrame) -> SeriesClassifier:
        train = train.where(F.col("label").isNotNull())
        self.codes = heads.collected(heads.label_codes(train))
        self.features.fit(train)
        made = self.features.transform(train, keep=("series_id", "label")).persist()
        try:
            self.scaler = heads.fit_scaler(made, "values")
            ready = heads.scaled(heads.encode(made, self.codes), self.scaler, "values", "z", ("series_id", "code"), scrub=True)
            self.head, self.errors = heads.ridge_cv(ready, self.codes.count(), self.alphas)
        finally:
            made.unpersist()
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """(series_id, predicted label)"""
        if self.head is None:
            raise ValueError("fit comes first")
        ready = heads.scaled(self.features.transform(rows), self.scaler, "values", "z", scrub=True)
        names = self.codes.select(F.col("code").alias("prediction"), F.col("label").alias("predicted"))
        return heads.predict(ready, self.head).join(names, "prediction").select("series_id", "predicted")

    def score(self, rows: DataFrame) -> float:
        """Share of right predictions; labels that training never had count as wrong, as do series without values."""
        joined = rows.where(F.col("label").isNotNull()).select("series_id", "label").join(self.predict(rows), "series_id", "left")
        return joined.agg(F.avg(F.coalesce(F.col("label") == F.col("predicted"), F.lit(False)).cast("double"))).first()[0]
