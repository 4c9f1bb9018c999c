"""Fit, predict and score."""

import numpy as np
import pytest

from wavecrest.api import SeriesClassifier, SeriesFeatures, from_matrix
from wavecrest.functions.banks import window_banks
from wavecrest.operators import embedding


def waves(n: int, seed: int):
    rng = np.random.RandomState(seed)
    y = rng.randint(0, 3, n)
    t = np.arange(96)
    x = np.sin(t[None] * (0.15 + 0.1 * y[:, None]) + rng.rand(n, 1) * 6) + 0.3 * rng.randn(n, 96)
    return x, [("slow", "middle", "fast")[k] for k in y]


def test_fit_predict_score(spark):
    train, test = (from_matrix(spark, *waves(n, s)) for n, s in ((60, 1), (40, 2)))
    model = SeriesClassifier().fit(train)
    assert len(model.head.mean) == 1512 + 760 and model.head.alpha in model.errors
    assert model.score(test) > 0.9
    assert {r.predicted for r in model.predict(test.repartition(3)).collect()} <= {"slow", "middle", "fast"}
    odd = from_matrix(spark, waves(4, 3)[0], ["other"] * 4)
    assert model.score(odd) == 0.0


def test_features_without_dictionary(spark):
    x, labels = waves(20, 4)
    df = from_matrix(spark, x[:, None, :], labels)
    features = SeriesFeatures(words=0, pooling="pruned", expand=False).fit(df)
    got = {r.series_id: r["values"] for r in features.transform(df).collect()}
    raw = embedding.embed_matrix(x, "pruned")
    z = (raw - raw.mean(0)) / np.where(raw.std(0) < 1e-12, 1, raw.std(0))
    assert np.allclose([got[i] for i in range(20)], z, atol=1e-6)
    with pytest.raises(ValueError, match="fit comes first"):
        SeriesFeatures().transform(df)


def test_own_banks(spark, tmp_path):
    df = from_matrix(spark, waves(3, 5)[0])
    own = {k: v * 0.5 for k, v in window_banks().items()}
    np.savez(tmp_path / "banks.npz", **own)
    one = embedding.embed(df, banks=own).orderBy("series_id").collect()
    two = embedding.embed(df, banks=str(tmp_path / "banks.npz")).orderBy("series_id").collect()
    plain = embedding.embed(df).orderBy("series_id").collect()
    assert one == two and one != plain
    with pytest.raises(ValueError, match="crf_w"):
        embedding.embed(df, banks={k: v for k, v in own.items() if k != "crf_w"})


def test_any_lengths_and_channels_without_dictionary(spark):
    rng = np.random.RandomState(9)
    rows = [(i, (np.sin(np.arange(n) * (0.2 if i % 2 else 0.9)) + 0.1 * rng.randn(n)).tolist(), "ab"[i % 2]) for i, n in enumerate(rng.randint(40, 200, 60))]
    schema = "series_id long, x array<double>, label string"
    df = spark.createDataFrame([*rows, (900, rows[0][1], None), (901, None, "a"), (902, [], "b")], schema)
    model = SeriesClassifier(SeriesFeatures(words=0)).fit(df.where("series_id <> 901 AND series_id <> 902"))
    assert len(model.head.mean) == 760 and model.score(spark.createDataFrame(rows, schema)) > 0.95
    assert model.score(df) == pytest.approx(model.score(spark.createDataFrame(rows, schema)) * 60 / 62)
    assert model.predict(df).count() == 61
    channels = df.selectExpr("series_id", "array(x, x) AS x", "label").where("size(x[0]) > 0")
    double = SeriesClassifier(SeriesFeatures(words=0, pooling="pruned", expand=False)).fit(channels)
    assert double.score(channels) > 0.9
    with pytest.raises(Exception, match="need one length"):
        SeriesClassifier().fit(df)


def test_entry_without_a_package_of_the_optional_part():
    """A package that only the training-data part needs may be missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 130 and got[1] == "False" and int(got[2]) > 100
