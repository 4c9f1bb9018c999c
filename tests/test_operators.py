"""Properties and edge cases of the series operators."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest.functions.banks import battery_banks, window_banks
from wavecrest.operators import battery, dictionary, embedding, evaluation, families, fourspace, heads, prep
from wavecrest.sources import results, series
from wavecrest.streaming.windows import stream_features

SF = "/root/testdata/sf0.001"
_RAW = {1: [3.5], 2: [1.0, 2.0], 63: list(np.sin(np.arange(63.0))), 64: list(np.arange(64.0)), 65: list(np.cos(np.arange(65.0))), 80: list(np.arange(80.0) ** 0.5), 256: list(np.sin(np.arange(256) / 3)), 600: list(np.cos(np.arange(600) / 7))}
EDGES = {n: [float(v) for v in x] for n, x in _RAW.items()}


def test_widths():
    assert families.COLUMNS == 173 and embedding.output_dim() == 519 and embedding.output_dim("pruned") == 211
    z = np.random.RandomState(0).randn(7, 519)
    assert battery.battery(z).shape == (7, 241)
    assert fourspace.FourSpace().width == 1410 and dictionary.fit_arrays(np.random.RandomState(1).randn(20, 64)).width == 1512
    for config in fourspace.CONFIGURATIONS.values():
        if config.width < 2000:
            assert fourspace.transform(z[:, :64], config).shape == (7, config.width)


def test_window_starts_and_lengths(spark):
    df = spark.createDataFrame([(n, x) for n, x in EDGES.items()] + [(0, [])], "series_id long, x array<double>")
    rows = prep.windows(df).collect()
    starts = {n: sorted(r.start for r in rows if r.series_id == n) for n in EDGES}
    assert starts[65] == [0, 1] and starts[80] == [0, 16] and len(starts[256]) == 13 and len(starts[600]) == 35 and starts[1] == starts[2] == starts[63] == starts[64] == [0]
    assert all(len(r.window) == 64 for r in rows) and not [r for r in rows if r.series_id == 0]


def test_native_and_arrow_forms_agree(spark):
    """Windows cut by column expressions and inside Arrow batches give the same embedding, for all lengths and any partitioning."""
    df = spark.createDataFrame([(n, x) for n, x in EDGES.items()], "series_id long, x array<double>")
    features = families.window_features(prep.windows(df))
    wide = {}
    for r in embedding.pooled(features).collect():
        wide[r.series_id, embedding.OPERATIONS.index(r.op) * 173 + r.col] = r.val
    for parts in (1, 4, 13):
        for r in embedding.embed(df.repartition(parts)).collect():
            assert np.allclose(r.embedding, [wide[r.series_id, c] for c in range(519)], atol=1e-9)
    pruned = {r.series_id: r.embedding for r in embedding.embed(df, "pruned").collect()}
    assert {len(v) for v in pruned.values()} == {211}
    assert math.isclose(pruned[600][0], wide[600, 2 * 173 + 12], abs_tol=1e-9)


def test_bad_values_and_empty_series(spark):
    bad = [float(x) for x in range(100)]
    nan, inf = [*bad[:50], float("nan"), *bad[51:]], [*bad[:50], float("inf"), *bad[51:]]
    df = spark.createDataFrame([(1, nan), (2, inf), (3, [5.0] * 64), (4, []), (5, None), (6, [None, *bad])], "series_id long, x array<double>")
    out = {r.series_id: r.embedding for r in embedding.embed(df).collect()}
    assert out[4] is None and out[5] is None
    zeros = embedding.embed(spark.createDataFrame([(1, [0.0] * 100)], "series_id long, x array<double>")).first().embedding
    assert np.allclose(out[1], zeros) and np.allclose(out[2], zeros) and np.isfinite(out[3]).all() and np.isfinite(out[6]).all()
    clean = {r.series_id: r.x for r in prep.normalised(df).collect()}
    assert set(clean[1]) == {0.0} and set(clean[3]) == {0.0} and set(clean[2]) == {0.0}
    shown = df.where("series_id = 2").select(prep.scrub(F.col("x")).alias("x")).first().x
    assert max(shown) == prep.BIGGEST


def test_channels_pool_as_one_bag(spark):
    a, b = EDGES[256], EDGES[80]
    df = spark.createDataFrame([(1, [a, b]), (2, [b, a]), (3, [a, [], None, b])], "series_id long, channels array<array<double>>")
    out = {r.series_id: np.array(r.embedding) for r in embedding.embed(df, column="channels").collect()}
    assert np.allclose(out[1], out[2], atol=1e-9) and np.allclose(out[1], out[3], atol=1e-9)


@settings(max_examples=15, deadline=None)
@given(st.floats(-50, 50), st.floats(0.5, 20), st.integers(0, 10**6))
def test_embedding_ignores_scale_and_shift(shift, scale, seed):
    x = np.random.RandomState(seed).randn(100)
    one, two = (families.phi(embedding.cut(embedding._znorm(v))) for v in (x, shift + scale * x))
    smooth = [i for i, (n, w) in enumerate(families.WIDTHS.items()) for _ in range(w) if n not in ("crf_ppv", "ricker_wavelet", "conv_position")]
    assert smooth and np.allclose(one[:, :24], two[:, :24], atol=1e-5)


def test_families_by_definition():
    """A few families restated sample by sample."""
    w = np.random.RandomState(4).randn(5, 64)
    made = {n: families.phi(w, [n]) for n in families.WIDTHS}
    kernels = window_banks()["crf_w"]
    for row, x in enumerate(w):
        c = x - x.mean()
        assert math.isclose(made["autocorr"][row, 1], sum(c[t] * c[t + 2] for t in range(62)) / (sum(c[t] ** 2 for t in range(62)) + 1e-8))
        response = [[sum(k[j] * x[t + 4 * (j - 4)] for j in range(9) if 0 <= t + 4 * (j - 4) < 64) for t in range(64)] for k in kernels]
        assert np.allclose(made["crf_max"][row, 16:], np.max(response, axis=1)) and np.allclose(made["crf_ppv"][row, 16:], (np.array(response) > 0).mean(1))
        acf = [sum(c[t] * c[t + k] for t in range(64 - k)) / (sum(c * c) + 1e-8) for k in range(1, 33)]
        low = next((i for i in range(1, 31) if acf[i] < acf[i - 1] and acf[i] <= acf[i + 1]), None)
        assert math.isclose(made["acf_first_min"][row, 0], (low + 1) / 64 if low else 0.5)
        lags = np.column_stack([c[1:63], c[:62]])
        beta = np.linalg.solve(lags.T @ lags + 1e-3 * np.eye(2), lags.T @ c[2:])
        assert math.isclose(made["ar_residual"][row, 0], math.log(np.var(c[2:] - lags @ beta, ddof=1) + 1e-8))


def test_constant_windows_are_finite():
    made = families.phi(np.vstack([np.zeros(64), np.full(64, 7.0), np.tile([0.0, 1.0], 32)]))
    assert np.isfinite(made).all()


def test_battery_rank_blocks_are_constant():
    z = np.random.RandomState(0).randn(40, 33)
    made = battery.battery(z, ["rankhist", "rankquant"])
    assert np.ptp(made, axis=0).max() == 0 and np.allclose(made[0, 8:], np.quantile(battery.rank_channel(z)[0], np.arange(9) / 8))
    ranks = battery.rank_channel(np.array([[2.0, 1.0, 2.0, 0.0]]))
    assert list(np.argsort(ranks[0])) == [3, 1, 0, 2]
    assert battery_banks(33)["W501"].shape == (33, 16)


def test_four_space_edges():
    assert fourspace.taps_in_range(64, 1) == 64 * 9 - 2 * (4 + 3 + 2 + 1)
    negative = -np.ones((1, 64))
    assert fourspace.kernel_features(negative, np.ones((1, 9)), np.array([1]), ["identity"], ["max"])[0, 0] == fourspace.LOW
    assert np.isnan(fourspace.statistics(np.array([[3.0]]))[0, 1])
    assert fourspace.kernel_features(negative, np.ones((2, 9)), np.array([1, 2]), ["other"], ["unknown", "ppv"]).shape == (1, 2)
    x = np.random.RandomState(2).randn(3, 65)
    assert np.allclose(fourspace.envelope(x).mean(), np.abs(np.fft.ifft(np.fft.fft(x) * np.r_[1, np.full(32, 2), np.zeros(32)])).mean())


def _blobs(spark, n=120, p=9, classes=3):
    rng = np.random.RandomState(5)
    y = rng.randint(0, classes, n)
    x = rng.randn(n, p) + 1.5 * np.eye(p)[y]
    return x, y, spark.createDataFrame([(i, int(c), list(map(float, r))) for i, (c, r) in enumerate(zip(y, x, strict=True))], "series_id long, code int, z array<double>").repartition(5)


@pytest.mark.parametrize("classes", [2, 3])
def test_ridge_leave_one_out(spark, classes):
    x, y, df = _blobs(spark, classes=classes)
    model, errors = heads.ridge_cv(df, classes, [0.1, 1.0, 30.0])
    t = heads.targets(y, classes)
    for a, error in errors.items():
        rest = []
        for i in range(len(x)):
            k = np.arange(len(x)) != i
            m, u = x[k].mean(0), t[k].mean(0)
            w = np.linalg.solve((x[k] - m).T @ (x[k] - m) + a * np.eye(x.shape[1]), (x[k] - m).T @ (t[k] - u))
            rest.append((t[i] - u - (x[i] - m) @ w) ** 2)
        assert math.isclose(error, np.mean(rest), rel_tol=1e-8)
    assert errors[model.alpha] == min(errors.values())
    alpha, dual = heads.ridge_dual_cv(x, t, [0.1, 1.0, 30.0])
    assert alpha == model.alpha and np.allclose(dual, list(errors.values()))
    fixed = heads.ridge_at(df, classes, model.alpha)
    assert np.allclose(fixed.weights, model.weights)
    predicted = {r.series_id: r.prediction for r in heads.predict(df, model).collect()}
    d = model.decide(x)
    want = (d[:, 0] > 0).astype(int) if classes == 2 else d.argmax(1)
    assert [predicted[i] for i in range(len(x))] == want.tolist()


def test_scaler_guards_constant_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0, 1e9 + 1e-8 * i]) for i in range(10)], "series_id long, x array<double>")
    scaler = heads.fit_scaler(df)
    assert scaler.scale[1] == 1.0 and np.isclose(scaler.scale[0], np.arange(10).std()) and scaler.scale[2] == 1.0
    with pytest.raises(ValueError, match="no rows"):
        heads.fit_scaler(df.limit(0))


def test_labels(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "label string")
    codes = heads.label_codes(train)
    assert {r.label: r.code for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    test = spark.createDataFrame([("c",), ("z",), (None,)], "label string")
    assert {r.label: r.code for r in heads.encode(test, codes).collect()} == {"c": 2, "z": -1, None: -1}
    with pytest.raises(Exception, match="unseen label: z"):
        heads.encode_strict(test.where("label = 'z'"), codes).collect()


def test_other_heads(spark):
    _, y, df = _blobs(spark)
    for fitted in (heads.logistic_head(df), heads.boosted_head(df, rounds=3)):
        from pyspark.ml.functions import array_to_vector

        out = fitted.transform(df.select(F.col("code").cast("double").alias("code"), array_to_vector("z").alias("v")))
        assert heads.accuracy(out).first().accuracy > 0.6


def test_ranks_and_unexplained_variance(spark):
    x = np.random.RandomState(1).randn(50, 6) @ np.diag([3.0, 2, 1, 1, 0.5, 0.1])
    b = heads.spanned_control(x, 4) + 0.1 * np.random.RandomState(2).randn(50, 4)
    df = spark.createDataFrame([(i, list(map(float, r)), list(map(float, t))) for i, (r, t) in enumerate(zip(x, b, strict=True))], "series_id long, a array<double>, b array<double>").repartition(4)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    participation, entropy = heads.spectrum_ranks(df.select(F.col("a").alias("x")))
    share = s / s.sum()
    assert math.isclose(participation, (s**2).sum() ** 2 / (s**4).sum(), rel_tol=1e-9) and math.isclose(entropy, np.exp(-(share * np.log(share)).sum()), rel_tol=1e-9)
    train, test = np.arange(50) < 35, np.arange(50) >= 35
    m, u = x[train].mean(0), b[train].mean(0)
    w = np.linalg.solve((x[train] - m).T @ (x[train] - m) + np.eye(6), (x[train] - m).T @ (b[train] - u))
    want = ((b[test] - u - (x[test] - m) @ w) ** 2).sum() / ((b[test] - u) ** 2).sum()
    assert math.isclose(heads.unexplained_variance(df.where("series_id < 35"), df.where("series_id >= 35")), want, rel_tol=1e-9)


# evaluation


def test_wilcoxon_exact_and_normal(spark):
    d = [0.3, -0.1, 0.25, 0.4, 0.05, -0.2, 0.15, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d)], "dataset long, d double")
    row = evaluation.signed_rank(df).first()
    assert (row.w_plus, row.w_minus, row.n) == (22.0, 6.0, 7)
    from itertools import product

    least = [sum(r for r, s in zip(range(1, 8), signs, strict=True) if s) <= 6 for signs in product((0, 1), repeat=7)]
    assert math.isclose(evaluation.signed_rank_p(row.w_plus, row.w_minus, row.n, row.tied, row.z), 2 * sum(least) / 128)
    assert math.isnan(evaluation.signed_rank_p(1, 2, 3, 0, None)) and evaluation.signed_rank(df.limit(3)).first().z is None
    assert 0 < evaluation.signed_rank_p(22.0, 6.0, 60, 6, -1.2) < 1
    assert evaluation.signed_rank(df.limit(0)).first().n == 0


def test_chi2_tail():
    for x, k, p in ((3.841459, 1, 0.05), (11.0705, 5, 0.05), (18.307, 10, 0.05), (0.5, 2, math.exp(-0.25)), (30.0, 2, math.exp(-15))):
        assert math.isclose(evaluation.chi2_tail(x, k), p, rel_tol=1e-4)


def test_missing_and_tied_results(spark):
    rows = [("d1", "a", 0.5), ("d1", "b", 0.5), ("d1", "c", None), ("d2", "a", 0.1), ("d2", "b", 0.4), ("d2", "c", float("nan")), ("d3", "a", 0.2)]
    df = spark.createDataFrame(rows, "dataset string, method string, accuracy double")
    got = {(r.dataset, r.method): r["rank"] for r in evaluation.ranks(df).collect()}
    assert got == {("d1", "a"): 1.5, ("d1", "b"): 1.5, ("d2", "a"): 2.0, ("d2", "b"): 1.0, ("d3", "a"): 1.0}
    assert {r.dataset for r in evaluation.complete(df, ["a", "b"]).collect()} == {"d1", "d2"}
    assert evaluation.win_tie_loss(evaluation.pair(df, "a", "b")).first().asDict() == {"wins": 0, "ties": 1, "losses": 1, "mean_difference": pytest.approx(-0.15), "n": 2}


# sources and sinks


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "wide.jsonl")
    with open(path, "w") as out:
        out.write('{"dataset": "x", "m1": 0.5, "m2_err": "boom"}\n\n{"dataset": "y", "m1": 0.25, "m2": 1.0}\n')
    wide = results.read_wide(spark, path)
    long = {(r.dataset, r.method): r.accuracy for r in results.to_long(wide).collect()}
    assert long == {("x", "m1"): 0.5, ("y", "m1"): 0.25, ("y", "m2"): 1.0}
    assert {r.dataset: r.errors for r in wide.collect()}["x"] == {"m2_err": "boom"}
    table = results.to_wide(results.to_long(wide))
    assert table.columns == ["dataset", "m1", "m2"] and {r.dataset: r.m2 for r in table.collect()} == {"x": None, "y": 1.0}
    runs = str(tmp_path / "runs")
    one = spark.createDataFrame([("x", "c1", 0.5, None), ("y", "c1", None, "failed")], "dataset string, config string, accuracy double, error string")
    results.append(one, runs)
    results.append(one.limit(1), runs)
    back = results.read_runs(spark, runs)
    assert back.count() == 3 and back.where("accuracy IS NOT NULL").count() == 2
    results.write_summary(results.to_long(wide), str(tmp_path / "summary"))
    made = json.loads(next((tmp_path / "summary").glob("part-*.json")).read_text())
    assert made["n_datasets"] == 2 and made["mean_accuracy"]["m2"] == 1.0 and set(made["configs"]) == {"m1", "m2"}
    names = tmp_path / "names.txt"
    names.write_text("  Adiac \n\nYoga\n")
    assert [r.dataset for r in results.read_names(spark, str(names)).collect()] == ["Adiac", "Yoga"]


def test_series_need_no_order_of_rows(spark):
    one = {r.series_id: r.x for r in series.user_values(spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy(F.rand(3)).repartition(7)
    two = {r.series_id: r.x for r in series.from_rows(events, "user_id", ("ts", "event_id"), "value").collect()}
    assert one == two


# streaming


def test_stream_windows_match_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6").select("user_id", "ts", "event_id", "value").orderBy("ts", "event_id").toPandas()
    for k in range(4):
        spark.createDataFrame(source[len(source) * k // 4 : len(source) * (k + 1) // 4]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = stream_features(stream, "user_id", ("ts", "event_id"), "value", ["stats", "turning"])
    query = made.writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.user_id, r.w): r["values"] for r in spark.sql("SELECT * FROM windows").collect()}
    want = {}
    for user, rows in source.groupby("user_id"):
        v = rows.sort_values(["ts", "event_id"])["value"].to_numpy()
        for w, start in enumerate(range(0, len(v) - 63, 16)):
            x = v[start : start + 64]
            want[user, w] = families.phi(((x - x.mean()) / (x.std() + 1e-8))[None], ["stats", "turning"])[0]
    assert set(got) == set(want) and want
    assert all(np.allclose(got[k], want[k]) for k in want)


# lengths, labels and memory bounds


@pytest.mark.parametrize("lengths", [(3, 5), (5, 3), (1, 7), (4, 4, 4, 8)])
def test_ragged_series_are_errors_where_one_length_is_needed(spark, lengths):
    """Also where the lengths' sum divides by the number of series."""
    df = spark.createDataFrame([(i, [float(i)] * n) for i, n in enumerate(lengths)], "series_id long, x array<double>").coalesce(1)
    calls = (
        lambda: fourspace.over_series(df, lambda x: x).collect(),
        lambda: heads.fit_scaler(df),
        lambda: battery.with_battery(df, "x").collect(),
        lambda: heads.predict(df, heads.Ridge(1.0, np.zeros(3), np.zeros(1), np.zeros((3, 1))), "x").collect(),
        lambda: dictionary.fit(df),
    )
    for call in calls:
        with pytest.raises(Exception, match=f"series of {min(lengths)} and of {max(lengths)} values"):
            call()


def test_null_series(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "series_id long, x array<double>").coalesce(1)
    assert fourspace.over_series(df, lambda x: x).count() == 1
    with pytest.raises(Exception, match="1 of 2 series are null"):
        heads.fit_scaler(df)


def test_null_labels_teach_nothing(spark):
    rng = np.random.RandomState(4)
    rows = [(i, rng.randn(5).tolist(), int(i % 2)) for i in range(40)]
    blank = [(100 + i, (rng.randn(5) + 50).tolist(), None) for i in range(40)]
    schema = "series_id long, x array<double>, label int"
    some, every = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + blank, schema)
    codes = heads.label_codes(every)
    one, two = (heads.ridge_at(heads.encode(df, codes), 2, 1.0, "x") for df in (some, every))
    assert abs(two.target_mean[0]) < 1e-12 and np.allclose(one.weights, two.weights) and np.allclose(one.mean, two.mean)
    cv = [heads.ridge_cv(heads.encode(df, codes), 2, features="x") for df in (some, every)]
    assert np.allclose(cv[0][0].weights, cv[1][0].weights) and cv[0][1] == pytest.approx(cv[1][1])
    assert heads.classify(some, some, "x").first() == heads.classify(every, every, "x").first()


def test_embedding_keeps_its_window_bound(spark, monkeypatch):
    """Many short series, one long one among them, and channels: no block beyond twice the bound, and the same numbers."""
    rng = np.random.RandomState(7)
    sizes = [64] * 30 + [3000] + [200] * 20 + [64]
    x = [rng.randn(n).cumsum().tolist() for n in sizes]
    df = spark.createDataFrame(list(enumerate(x)), "series_id long, x array<double>").coalesce(1)
    want = {r.series_id: r.embedding for r in embedding.embed(df).collect()}
    seen = []

    def local(rows, column_type, column):
        """The same Arrow function without Spark's workers."""
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"series_id": list(range(len(column))), "x": pa.array(column, column_type)})
        held = {}
        original = type(rows).mapInArrow
        try:
            type(rows).mapInArrow = lambda self, work, schema: held.setdefault("work", work)
            embedding.embed(rows)
        finally:
            type(rows).mapInArrow = original
        return [r for b in held["work"](iter([batch])) for r in b.to_pylist()]

    import pyarrow as pa

    plain = embedding.phi
    monkeypatch.setattr(embedding, "BLOCK_WINDOWS", 40)
    monkeypatch.setattr(embedding, "phi", lambda w, *a: seen.append(len(w)) or plain(w, *a))
    for row in local(df, pa.list_(pa.float64()), x):
        assert np.allclose(row["embedding"], want[row["series_id"]], atol=1e-9)
    assert max(seen) <= 80 and sum(seen) == sum(len(embedding.starts(np.array(v))[1]) for v in x)


def test_embedding_of_ten_million_values(spark):
    """One series of 10 million values, pooled in pieces, against its pieces' windows."""
    x = np.sin(np.arange(10_000_000) / 50) + np.arange(10_000_000) % 7
    at = embedding.starts(x)[1]
    names = ["curvature"]
    pooled = embedding._pool_in_pieces([(x, at)], names, {"curvature": ("mean", "std", "max")}, None)[0]
    sums, squares, top = np.zeros(3), np.zeros(3), np.full(3, -np.inf)
    for k in range(0, len(at), 50_000):
        f = families.phi(x[at[k : k + 50_000, None] + np.arange(64)], names)
        sums, squares, top = sums + f.sum(0), squares + (f * f).sum(0), np.maximum(top, f.max(0))
    mean = sums / len(at)
    assert np.allclose(pooled[:3], mean) and np.allclose(pooled[3:6], np.sqrt(np.maximum(squares / len(at) - mean**2, 0)), atol=1e-5) and np.allclose(pooled[6:], top)


def test_minirocket_uses_a_series_for_each_kernel_and_dilation(spark):
    x = np.random.RandomState(3).randn(700, 64)
    model = dictionary.fit_arrays(x)
    for number, (d, n) in enumerate(zip(model.dilations, model.share, strict=True)):
        for k in (0, 83):
            r = families.dilated(x[[(k + 84 * number) % 700]], dictionary.kernels()[[k]], int(d))[0, :, 0]
            assert r.min() <= model.biases[number][k].min() and model.biases[number][k].max() <= r.max()
    assert dictionary.fit_arrays(x[:5]).width == 1512


def test_pairs_at_once(spark):
    df = spark.createDataFrame([(d, m, round(((d * 7 + k * 13) % 11) / 10, 1)) for d in range(20) for k, m in enumerate("abc")] + [(99, "a", None), (99, "b", 0.5)], "dataset long, method string, accuracy double")
    for r in evaluation.pair_table(df, [("a", "b"), ("b", "c"), ("a", "c")]).collect():
        alone = evaluation.wilcoxon(df, r.a, r.b)
        assert (r.wins, r.ties, r.losses, r.n, r.w_plus, r.w_minus) == tuple(alone[k] for k in ("wins", "ties", "losses", "n", "w_plus", "w_minus"))
        assert r.mean_difference == pytest.approx(alone["mean_difference"])
