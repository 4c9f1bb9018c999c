"""All queries of the series engine, by name, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.api import SeriesFeatures
from wavecrest.functions.banks import fourier_projections, gaussian_windows, random_kernels, statistic_nets
from wavecrest.functions.columns import long, rounded
from wavecrest.operators import battery as bat
from wavecrest.operators import dictionary, embedding, evaluation, families, fourspace, heads, prep
from wavecrest.plans import sql
from wavecrest.sources import results, series

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Frames that the last query keeps in memory because it reads them more than once; the next query lets them go.
_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    _HELD.append(df.persist())
    return df


def release() -> None:
    while _HELD:
        _HELD.pop().unpersist()


def _alone(function: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        release()
        return function(spark, sf)

    return run


def add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _SQL[name] = oracle


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        add(name, function, oracle)
        return function

    return register


def queries() -> dict[str, Query]:
    return {name: _alone(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# series preparation


def _long(source, expression):
    return lambda spark, sf: long(source(spark, sf).select("series_id", expression(F.col("x")).alias("values")), ["series_id"])


_Z = sql.clean("SELECT id AS series_id, t AS col, v AS val FROM z")
add("prep_znorm", _long(series.vectors, prep.znorm), f"WITH {sql.znormed(sql.S1)} {_Z}")
add("prep_znorm_ragged", _long(series.user_values, prep.znorm), f"WITH {sql.znormed(sql.S2)} {_Z}")
add("prep_diff", _long(series.vectors, prep.diff), f"WITH {sql.rows(sql.S1)} " + sql.clean("SELECT id AS series_id, t - 1 AS col, v - lag(v) OVER (PARTITION BY id ORDER BY t) AS val FROM r QUALIFY t > 0"))
add("prep_diff_padded", _long(series.vectors, prep.diff_padded), f"WITH {sql.rows(sql.S1)} " + sql.clean("SELECT id AS series_id, t AS col, coalesce(lead(v) OVER (PARTITION BY id ORDER BY t) - v, 0) AS val FROM r"))
add(
    "prep_hilbert_envelope",
    lambda spark, sf: long(fourspace.over_series(series.vectors(spark, sf), fourspace.envelope), ["series_id"]),
    f"WITH {sql.rows(sql.S1)}, f AS (SELECT id, k, sum(v * cos(2*pi()*k*t/64)) AS re, -sum(v * sin(2*pi()*k*t/64)) AS im FROM r CROSS JOIN range(33) g(k) GROUP BY id, k) "
    + sql.clean("SELECT id AS series_id, t AS col, sqrt(sum(h * (re * cos(2*pi()*k*t/64) - im * sin(2*pi()*k*t/64)))**2 + sum(h * (re * sin(2*pi()*k*t/64) + im * cos(2*pi()*k*t/64)))**2) / 64 AS val FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS h FROM f) CROSS JOIN range(64) x(t) GROUP BY id, t"),
)
_HOLES = "CASE WHEN (id * 7 + t) % 97 = 0 THEN 'nan'::DOUBLE WHEN (id * 11 + t) % 89 = 0 THEN 'inf'::DOUBLE ELSE v END"


@query("prep_scrub", f"WITH {sql.rows(sql.S1)} " + sql.clean(f"SELECT id AS series_id, t AS col, CASE WHEN isnan(q) THEN 0 WHEN isinf(q) THEN 1e300 ELSE q END AS val FROM (SELECT id, t, {_HOLES} AS q FROM r)"))
def prep_scrub(spark, sf):
    """NaN and infinities put into the vectors by a rule, and scrubbed; the largest double is shown as 1e300."""
    holes = F.transform("x", lambda v, t: F.when((F.col("series_id") * 7 + t) % 97 == 0, float("nan")).when((F.col("series_id") * 11 + t) % 89 == 0, float("inf")).otherwise(v))
    shown = F.transform(prep.scrub(holes), lambda v: F.least(v, F.lit(1e300)))
    cells = series.vectors(spark, sf).select("series_id", F.posexplode(shown).alias("col", "val"))
    return cells.withColumn("val", F.when(F.col("val") < 1e299, rounded(F.col("val"))).otherwise(F.col("val")))


@query("prep_scrub_series", f"WITH {sql.rows(sql.S2)} " + sql.clean("SELECT id AS series_id, t AS col, CASE WHEN id % 3 = 0 THEN 0 ELSE (v - avg(v) OVER (PARTITION BY id)) / (stddev_pop(v) OVER (PARTITION BY id) + 1e-8) END AS val FROM r"))
def prep_scrub_series(spark, sf):
    """One NaN makes the whole normalised series 0, as scrubbing comes after it."""
    x = F.when(F.col("series_id") % 3 == 0, F.transform("x", lambda v, i: F.when(i == 0, float("nan")).otherwise(v))).otherwise(F.col("x"))
    return long(prep.normalised(series.user_values(spark, sf).withColumn("x", x)).select("series_id", F.col("x").alias("values")), ["series_id"])


for _name, _source, _text in (("users", series.user_values, sql.S2), ("short", series.customer_orders, sql.S4)):
    add(
        f"prep_windows_{_name}",
        lambda spark, sf, source=_source: prep.windows(source(spark, sf)).select("series_id", "w", "start", F.posexplode("window").alias("col", "val")).withColumn("val", rounded(F.col("val"))),
        f"WITH {sql.windows(_text)} " + sql.clean("SELECT id AS series_id, w, start, t AS col, v AS val FROM win", "series_id, w, start"),
    )
add(
    "prep_windows_index",
    lambda spark, sf: prep.windows(series.supplier_prices(spark, sf)).select("series_id", "w", "start"),
    f"WITH {sql.rows(sql.S3)}, q AS (SELECT DISTINCT id, n FROM r), st AS (SELECT DISTINCT id, unnest(list_concat(range(0, n - 63, 16), [n - 64])) AS start FROM q) SELECT id AS series_id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS w, start::INT AS start FROM st",
)
add(
    "prep_resample_short",
    lambda spark, sf: long(series.customer_orders(spark, sf).where("size(x) BETWEEN 2 AND 63").select("series_id", prep.resample_short(F.col("x")).alias("values")), ["series_id"]),
    f"WITH {sql.rows(sql.S4)}, q AS (SELECT DISTINCT id, n FROM r WHERE n BETWEEN 2 AND 63) "
    + sql.clean("SELECT q.id AS series_id, i AS col, a.v + (c.v - a.v) * (i * (q.n - 1) / 63e0 - a.t) AS val FROM q CROSS JOIN range(64) g(i) JOIN r a ON a.id = q.id AND a.t = least(floor(i * (q.n - 1) / 63e0), q.n - 2) JOIN r c ON c.id = q.id AND c.t = a.t + 1"),
)
add(
    "prep_edge_pad",
    lambda spark, sf: long(series.customer_orders(spark, sf).where("size(x) < 64").select("series_id", prep.edge_pad(F.col("x")).alias("values")), ["series_id"]),
    f"WITH {sql.rows(sql.S4)} " + sql.clean("SELECT id AS series_id, i AS col, x[greatest(i - (64 - n), 0) + 1] AS val FROM (SELECT id, x, len(x) AS n FROM s WHERE len(x) < 64) CROSS JOIN range(64) g(i)"),
)

# window families, pooling, embeddings


def window_family(source, names):
    return lambda spark, sf: long(families.window_features(prep.windows(source(spark, sf)), names), ["series_id", "w"])


for _name in families.WIDTHS:
    add(f"fam_{_name}", window_family(series.vectors, [_name]), sql.family_query(_name, sql.S1))
    add(f"fam_{_name}_users", window_family(series.user_values, [_name]), sql.family_query(_name, sql.S2))


def _pooled(frame: DataFrame) -> DataFrame:
    return frame.withColumn("val", rounded(F.col("val")))


def _features(spark, sf, source, names):
    return families.window_features(prep.windows(source(spark, sf)), names)


add("pool_full_stats", lambda spark, sf: _pooled(embedding.pooled(_features(spark, sf, series.user_values, ["stats"]))), sql.pooled_query("stats", sql.S2))
for _name in ("ricker_wavelet", "crf_ppv", "ar_residual", "curvature"):
    _ops = embedding.PRUNED[_name]
    add(f"pool_pruned_{_name}", lambda spark, sf, n=_name, ops=_ops: _pooled(embedding.pooled(_features(spark, sf, series.user_values, [n]), operations=ops)), sql.pooled_query(_name, sql.S2, _ops))


@query("pool_multichannel", sql.pooled_query("turning", sql.S3_CHANNELS, bag="id // 4"))
def pool_multichannel(spark, sf):
    """Windows of all four channels of a supplier pooled as one bag."""
    channels = series.supplier_channels(spark, sf).select(F.col("series_id").alias("bag"), F.explode("channels").alias("x"))
    cut = prep.windows(channels.withColumn("series_id", F.col("bag")))
    return _pooled(embedding.pooled(families.window_features(cut, ["turning"])))


def _embedding_sql() -> str:
    parts, at = [], 0
    for name, width in families.WIDTHS.items():
        more, inner = sql.family(name)
        for k, value in enumerate(("val", "0e0", "val")):
            parts.append(f"SELECT id AS series_id, {k * families.COLUMNS + at} + col AS col, {value} AS val FROM (WITH _d AS (SELECT 1){', ' + more if more else ''} {inner})")
        at += width
    return f"WITH {sql.windows(sql.S1)} " + sql.clean(" UNION ALL ".join(parts))


def _pruned_sql(source: str) -> str:
    function, parts, at = {"mean": "avg(val)", "std": "stddev_pop(val)", "max": "max(val)"}, [], 0
    for name, width in families.WIDTHS.items():
        for operation in (o for o in embedding.OPERATIONS if o in embedding.PRUNED.get(name, ())):
            more, inner = sql.family(name)
            parts.append(f"SELECT id AS series_id, {at} + col AS col, {function[operation]} AS val FROM (WITH _d AS (SELECT 1){', ' + more if more else ''} {inner}) GROUP BY ALL")
            at += width
    return f"WITH {sql.windows(source)} " + sql.clean(" UNION ALL ".join(parts))


add("embed519", lambda spark, sf: long(embedding.embed(series.vectors(spark, sf)).select("series_id", F.col("embedding").alias("values")), ["series_id"]), _embedding_sql())
add("embed211", lambda spark, sf: long(embedding.embed(series.user_values(spark, sf), "pruned").select("series_id", F.col("embedding").alias("values")), ["series_id"]), _pruned_sql(sql.S2))
add("embed519_suppliers", lambda spark, sf: long(embedding.embed(series.supplier_prices(spark, sf)).select("series_id", F.col("embedding").alias("values")), ["series_id"]), sql.embedding_query(sql.S3))
add("embed519_multichannel", lambda spark, sf: long(embedding.embed(series.supplier_channels(spark, sf), column="channels").select("series_id", F.col("embedding").alias("values")), ["series_id"]))


def star(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, label, z): the 519 columns scaled by training rows, and 241 battery columns."""
    embedded = hold(embedding.embed(series.vectors(spark, sf), keep=("label",)))
    scaler = heads.fit_scaler(embedded.where(~series.is_test(F.col("series_id"))), "embedding")
    scaled = heads.scaled(embedded, scaler, "embedding", "z", ("series_id", "label"))
    return bat.with_battery(scaled, "z", output="values", keep=("series_id", "label"), append=True)


add("embed760", lambda spark, sf: long(star(spark, sf).select("series_id", "values"), ["series_id"]))


def full_features(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, label, values): 1,512 dictionary columns and the 760, in one narrow stage."""
    source = series.vectors(spark, sf)
    features = SeriesFeatures().fit(source.where(~series.is_test(F.col("series_id"))))
    return features.transform(source, keep=("series_id", "label"))


@query("embed2272")
def embed2272(spark, sf):
    return full_features(spark, sf).select("series_id", F.size("values").alias("width"), rounded(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# battery


def _battery_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.vectors(spark, sf)
    return heads.scaled(rows, heads.fit_scaler(rows), "x", "z")


for _name, (_channel, _bank, _) in bat.BLOCKS.items():
    add(f"bat_{_name}", lambda spark, sf, n=_name: long(bat.with_battery(_battery_source(spark, sf), names=[n]), ["series_id"]), sql.battery_query(_name, _channel, _bank))
add("bat_rank_channel", lambda spark, sf: long(fourspace.over_series(_battery_source(spark, sf), bat.rank_channel, "z"), ["series_id"]), sql.RANK_CHANNEL)

# four-space


def _over(source, function, digits: int = 6):
    return lambda spark, sf: long(fourspace.over_series(source(spark, sf), function), ["series_id"], digits=digits)


add("four_temporal", _over(series.vectors, lambda x: x @ gaussian_windows(64, 12).T), sql.temporal_query(12))
add("four_fourier", _over(series.vectors, lambda x: fourspace.fourier(x, fourier_projections(64, 2, 16))), sql.fourier_query(2, 16))
add("four_statistics", _over(series.vectors, fourspace.statistics), sql.STATISTICS_QUERY)
add("four_nets", _over(series.vectors, lambda x: fourspace.nets(fourspace.statistics(x), statistic_nets(10))), sql.nets_query(10))


def _kernels(transform: str, pooling: str):
    # a mean position has many exact decimal halves at six digits
    return _over(series.vectors, lambda x: fourspace.kernel_features(x, *random_kernels(64, 6), [transform], [pooling]), 10 if pooling == "mipv" else 6)


for _pool in fourspace.POOLS:
    add(f"four_kernel_{_pool}", _kernels("identity", _pool), sql.kernel_query(_pool))
for _transform in ("diff", "hilbert"):
    add(f"four_kernel_{_transform}", _kernels(_transform, "max"), sql.kernel_query("max", _transform))
    for _pool in ("ppv", "mpv", "mipv"):
        add(f"four_kernel_{_transform}_{_pool}", _kernels(_transform, _pool), sql.kernel_query(_pool, _transform))
add("four_concat1410", lambda spark, sf: long(fourspace.four_space(series.vectors(spark, sf)), ["series_id"]), sql.four_space_query())

# windows, projections, nets, kernels, transforms, poolings, dictionary features of each configuration, as published
_CONFIGS = """VALUES ('temporal_only', 200, 0, 0, 0, 1, 2, 0), ('fourier_only', 0, 5, 0, 0, 1, 2, 0), ('statistic_only', 0, 0, 200, 0, 1, 2, 0), ('kernel_only', 0, 0, 0, 500, 1, 2, 0),
('temporal+fourier', 200, 5, 0, 0, 1, 2, 0), ('temporal+statistic', 200, 0, 200, 0, 1, 2, 0), ('temporal+kernel', 200, 0, 0, 500, 1, 2, 0), ('fourier+statistic', 0, 5, 200, 0, 1, 2, 0), ('fourier+kernel', 0, 5, 0, 500, 1, 2, 0), ('statistic+kernel', 0, 0, 200, 500, 1, 2, 0),
('temporal+fourier+statistic', 200, 5, 200, 0, 1, 2, 0), ('full', 200, 5, 200, 500, 1, 2, 0), ('small', 50, 3, 50, 100, 1, 1, 0), ('kernel_700', 0, 0, 0, 700, 1, 2, 0), ('minirocket', 0, 0, 0, 0, 1, 2, 10000),
('rocket_ppv', 0, 0, 0, 10000, 1, 1, 0), ('rocket_ppv+mpv', 0, 0, 0, 10000, 1, 2, 0), ('rocket_full', 0, 0, 0, 10000, 2, 3, 0),
('rocket_ppv+nonkernel', 200, 5, 200, 10000, 1, 1, 0), ('rocket_ppv+mpv+nonkernel', 200, 5, 200, 10000, 1, 2, 0), ('rocket_full+nonkernel', 200, 5, 200, 10000, 2, 3, 0), ('rocket_5000_ppv+max', 0, 0, 0, 5000, 1, 2, 0)"""


@query("four_configurations", f"SELECT *, (CASE WHEN dictionary > 0 THEN dictionary // 84 * 84 ELSE windows + 2 * projections + nets + kernels * transforms * poolings END)::INT AS width FROM ({_CONFIGS}) t(config, windows, projections, nets, kernels, transforms, poolings, dictionary)")
def four_configurations(spark, sf):
    """Each ablation configuration, the random-kernel baseline, and the widths that their transforms have."""
    every = [*fourspace.CONFIGURATIONS.values(), fourspace.ROCKET_PPV_MAX]
    rows = [(c.name, c.windows, c.projections, c.nets if c.nets else 0, c.kernels, len(c.transforms), len(c.poolings), c.dictionary, c.width) for c in every]
    return spark.createDataFrame(rows, "config string, windows int, projections int, nets int, kernels int, transforms int, poolings int, dictionary int, width int")


@query("four_rocket5000")
def four_rocket5000(spark, sf):
    """The baseline of 5,000 random kernels with two poolings: each vector's width and total."""
    made = fourspace.four_space(series.vectors(spark, sf), fourspace.ROCKET_PPV_MAX)
    return made.select("series_id", F.size("values").alias("width"), rounded(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# dictionary

add("dict_minirocket_fixed", lambda spark, sf: long(dictionary.ppv_at_zero(series.vectors(spark, sf)), ["series_id"]), sql.rocket_query())


@query("dict_minirocket1512")
def dict_minirocket(spark, sf):
    source = series.vectors(spark, sf)
    return long(dictionary.apply(source, dictionary.fit(source.where(~series.is_test(F.col("series_id"))))), ["series_id"])


@query("dict_minirocket168", sql.fitted_rocket_query())
def dict_minirocket168(spark, sf):
    """Biases from training vectors, and both paddings, at two dilations."""
    source = series.vectors(spark, sf)
    return long(dictionary.apply(source, dictionary.fit(source.where(~series.is_test(F.col("series_id"))), 168)), ["series_id"])


# models

_SPLIT = "SELECT vec_id AS id, embedding::DOUBLE[] AS x, label, vec_id % 5 = 0 AS test FROM embeddings"
_CELLS = f"s AS ({_SPLIT}), r AS (SELECT id, label, test, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS t FROM s), mo AS (SELECT t, avg(v) AS mean, stddev_pop(v) AS std FROM r WHERE NOT test GROUP BY t)"


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, test = series.vectors(spark, sf), series.is_test(F.col("series_id"))
    return rows.where(~test), rows.where(test)


@query("split_train_test", "SELECT vec_id AS series_id, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM embeddings")
def split_train_test(spark, sf):
    return series.vectors(spark, sf).select("series_id", "label", F.when(series.is_test(F.col("series_id")), "test").otherwise("train").alias("part"))


@query("model_scaler_fit", f"WITH {_CELLS} SELECT t::INT AS col, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM mo")
def model_scaler_fit(spark, sf):
    return heads.column_moments(_split(spark, sf)[0]).select("col", rounded(F.col("mean")).alias("mean"), F.round("std", 6).alias("std"))


@query("model_scaler_apply", f"WITH {_CELLS} " + sql.clean("SELECT id AS series_id, t AS col, (v - mean) / std AS val FROM r JOIN mo USING (t) WHERE test"))
def model_scaler_apply(spark, sf):
    train, test = _split(spark, sf)
    return long(heads.scaled(test, heads.fit_scaler(train)).withColumnRenamed("z", "values"), ["series_id"])


@query("model_label_encode", f"WITH {_CELLS}, c AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT DISTINCT label FROM s WHERE NOT test AND label IS NOT NULL)) SELECT id AS series_id, label, coalesce(code, -1)::INT AS code FROM s LEFT JOIN c USING (label)")
def model_label_encode(spark, sf):
    train, _ = _split(spark, sf)
    return heads.encode(series.vectors(spark, sf), heads.label_codes(train)).select("series_id", "label", "code")


@query("model_label_unseen", f"WITH {_CELLS}, c AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT DISTINCT label FROM s WHERE NOT test AND label < 7)) SELECT id AS series_id, coalesce(code, -1)::INT AS code FROM s LEFT JOIN c USING (label) WHERE test")
def model_label_unseen(spark, sf):
    """Labels from 7 on are kept out of training, so their test rows get -1."""
    train, test = _split(spark, sf)
    return heads.encode(test, heads.label_codes(train.where("label < 7"))).select("series_id", "code")


@query("model_distinct_classes", "SELECT count(DISTINCT label)::BIGINT AS classes FROM embeddings")
def model_distinct_classes(spark, sf):
    return series.vectors(spark, sf).agg(F.count_distinct("label").alias("classes"))


_RIDGE3 = f"""WITH {_CELLS}, f AS (SELECT id, CASE WHEN any_value(label) = 0 THEN 1e0 ELSE -1e0 END AS y, sum(CASE WHEN t = 0 THEN (v - mean) / std END) AS a, sum(CASE WHEN t = 1 THEN (v - mean) / std END) AS b, sum(CASE WHEN t = 2 THEN (v - mean) / std END) AS c FROM r JOIN mo USING (t) WHERE NOT test AND t < 3 GROUP BY id),
g AS (SELECT a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c, y - avg(y) OVER () AS y FROM f),
m AS (SELECT sum(a*a) + 1 AS p, sum(a*b) AS q, sum(a*c) AS r, sum(b*b) + 1 AS s, sum(b*c) AS u, sum(c*c) + 1 AS w, sum(a*y) AS x, sum(b*y) AS y, sum(c*y) AS z FROM g),
d AS (SELECT *, p*(s*w - u*u) - q*(q*w - u*r) + r*(q*u - s*r) AS det FROM m),
o AS (SELECT unnest(range(3)) AS col, unnest([(x*(s*w - u*u) - q*(y*w - u*z) + r*(y*u - s*z)) / det, (p*(y*w - u*z) - x*(q*w - u*r) + r*(q*z - y*r)) / det, (p*(s*z - y*u) - q*(q*z - y*r) + x*(q*u - s*r)) / det]) AS val FROM d)
SELECT col::INT AS col, round(val, 6) + 0.0 AS val FROM o"""


@query("model_ridge3_fixed_alpha", _RIDGE3)
def model_ridge3(spark, sf):
    """Three scaled columns, one class against the rest, alpha 1."""
    train, _ = _split(spark, sf)
    scaled = heads.scaled(train, heads.fit_scaler(train), keep=("series_id", "label")).select("series_id", F.slice("z", 1, 3).alias("z"), (F.col("label") == 0).cast("int").alias("code"))
    model = heads.ridge_at(scaled, 2, 1.0)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.weights[:, 0])], "col int, val double").withColumn("val", rounded(F.col("val")))


_HALF3 = f"""{_CELLS}, f AS (SELECT id, test, CASE WHEN any_value(label) < 5 THEN 1e0 ELSE -1e0 END AS y, sum(CASE WHEN t = 0 THEN (v - mean) / std END) AS a, sum(CASE WHEN t = 1 THEN (v - mean) / std END) AS b, sum(CASE WHEN t = 2 THEN (v - mean) / std END) AS c FROM r JOIN mo USING (t) WHERE t < 3 GROUP BY id, test),
mm AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM f WHERE NOT test), g AS (SELECT id, test, y AS target, a - ma AS a, b - mb AS b, c - mc AS c, y - my AS y, my FROM f, mm),
m AS (SELECT count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc, sum(a*y) AS ay, sum(b*y) AS yb, sum(c*y) AS cy FROM g WHERE NOT test),
q AS (SELECT n, ay, yb, cy, k, alpha, aa + alpha AS p, ab AS q, ac AS r, bb + alpha AS s, bc AS u, cc + alpha AS w FROM m, (SELECT unnest(range(13)) AS k, unnest({sql.numbers(heads.ALPHAS)}) AS alpha)),
d AS (SELECT *, p*(s*w - u*u) - q*(q*w - u*r) + r*(q*u - s*r) AS det FROM q), i AS (SELECT *, (s*w - u*u) / det AS i1, (r*u - q*w) / det AS i2, (q*u - r*s) / det AS i3, (p*w - r*r) / det AS i4, (q*r - p*u) / det AS i5, (p*s - q*q) / det AS i6 FROM d),
be AS (SELECT *, i1*ay + i2*yb + i3*cy AS wa, i2*ay + i4*yb + i5*cy AS wb, i3*ay + i5*yb + i6*cy AS wc FROM i),
er AS (SELECT k, alpha, avg(((g.y - wa*g.a - wb*g.b - wc*g.c) / (1 - 1e0 / n - (i1*g.a*g.a + i4*g.b*g.b + i6*g.c*g.c + 2*i2*g.a*g.b + 2*i3*g.a*g.c + 2*i5*g.b*g.c)))**2) AS error FROM g, be WHERE NOT test GROUP BY ALL),
pr AS (SELECT id AS series_id, (target > 0)::INT AS code, (my + wa*a + wb*b + wc*c > 0)::INT AS prediction FROM g, be WHERE test AND k = (SELECT k FROM er ORDER BY error, k LIMIT 1))"""


def _half3(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of three scaled columns, and whether the label is below 5."""
    train, test = _split(spark, sf)
    scaler = heads.fit_scaler(train)
    made = [heads.scaled(part, scaler, keep=("series_id", "label")).select("series_id", F.slice("z", 1, 3).alias("z"), (F.col("label") < 5).cast("int").alias("code")) for part in (train, test)]
    return made[0], made[1]


@query("model_ridge3_gcv", f"WITH {_HALF3} SELECT alpha, round(error, 6) AS error, k = (SELECT k FROM er ORDER BY error, k LIMIT 1) AS chosen FROM er")
def model_ridge3_gcv(spark, sf):
    """Leave-one-out errors of all alphas on three columns, which SQL has in closed form."""
    model, errors = heads.ridge_cv(_half3(spark, sf)[0], 2)
    return spark.createDataFrame([(a, float(e), a == model.alpha) for a, e in errors.items()], "alpha double, error double, chosen boolean").withColumn("error", F.round("error", 6))


@query("model_predict3", f"WITH {_HALF3} SELECT * FROM pr")
def model_predict3(spark, sf):
    train, test = _half3(spark, sf)
    return heads.predict(test, heads.ridge_cv(train, 2)[0], keep=("series_id", "code"))


@query("model_accuracy3", f"WITH {_HALF3} SELECT avg((code = prediction)::INT::DOUBLE) AS accuracy, count(*)::BIGINT AS n FROM pr")
def model_accuracy3(spark, sf):
    return heads.accuracy(model_predict3(spark, sf))


@query("model_boosted")
def model_boosted(spark, sf):
    """A few rounds of the boosted head on the three columns."""
    from pyspark.ml.functions import array_to_vector

    train, test = _half3(spark, sf)
    fitted = heads.boosted_head(train, rounds=5)
    return heads.accuracy(fitted.transform(test.select(F.col("code").cast("double").alias("code"), array_to_vector("z").alias("v"))))


def _coded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    train, test = _split(spark, sf)
    codes, scaler = heads.label_codes(train), heads.fit_scaler(train)
    made = [heads.scaled(heads.encode(part, codes), scaler, keep=("series_id", "code")) for part in (train, test)]
    return made[0], made[1], codes.count()


@query("model_ridge_gcv")
def model_ridge_gcv(spark, sf):
    train, _, classes = _coded(spark, sf)
    model, errors = heads.ridge_cv(train, classes)
    return spark.createDataFrame([(a, float(e), a == model.alpha) for a, e in errors.items()], "alpha double, error double, chosen boolean").withColumn("error", F.round("error", 6))


@query("model_predict")
def model_predict(spark, sf):
    train, test, classes = _coded(spark, sf)
    return heads.predict(test, heads.ridge_cv(train, classes)[0], keep=("series_id", "code"))


@query("model_accuracy")
def model_accuracy(spark, sf):
    return heads.accuracy(model_predict(spark, sf))


@query("model_classify_star")
def model_classify_star(spark, sf):
    rows, test = hold(star(spark, sf)), series.is_test(F.col("series_id"))
    return heads.classify(rows.where(~test), rows.where(test), "values")


@query("model_classify_full")
def model_classify_full(spark, sf):
    rows, test = hold(full_features(spark, sf)), series.is_test(F.col("series_id"))
    return heads.classify(rows.where(~test), rows.where(test), "values")


@query("model_classify_four_space")
def model_classify_four_space(spark, sf):
    rows, test = fourspace.four_space(series.vectors(spark, sf), keep=("series_id", "label")), series.is_test(F.col("series_id"))
    return heads.classify(rows.where(~test), rows.where(test), "values", alphas=heads.WIDE_ALPHAS)


@query("model_logistic")
def model_logistic(spark, sf):
    train, test, _ = _coded(spark, sf)
    from pyspark.ml.functions import array_to_vector

    fitted = heads.logistic_head(train)
    out = fitted.transform(test.select("series_id", F.col("code").cast("double").alias("code"), array_to_vector("z").alias("v")))
    return heads.accuracy(out)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, a, b): the kernel block and the window block of every series."""
    rows = series.vectors(spark, sf)
    kernels = dictionary.ppv_at_zero(rows).withColumnRenamed("values", "a")
    return kernels.join(embedding.embed(rows, "pruned").withColumnRenamed("embedding", "b"), "series_id")


@query("eval_unexplained_variance")
def eval_unexplained_variance(spark, sf):
    """How much of the window block, and of an equally wide mixture of the kernel block, a ridge from the kernel block leaves."""
    rows, test = hold(_blocks(spark, sf)), series.is_test(F.col("series_id"))
    mixed = hold(fourspace.over_series(rows, lambda x: heads.spanned_control(x, embedding.output_dim("pruned")), "a", ("series_id", "a")).withColumnRenamed("values", "b"))
    made = [(name, round(heads.unexplained_variance(r.where(~test), r.where(test)), 6)) for name, r in (("window_block", rows), ("spanned_control", mixed))]
    return spark.createDataFrame(made, "block string, unexplained double")


@query("eval_entropy_rank")
def eval_entropy_rank(spark, sf):
    rows = hold(_blocks(spark, sf))
    made = [(name, *(round(v, 6) for v in heads.spectrum_ranks(rows.select(c.alias("x"))))) for name, c in (("kernel_block", F.col("a")), ("both_blocks", F.concat("a", "b")))]
    return spark.createDataFrame(made, "block string, participation double, entropy double")


@query("eval_complementarity")
def eval_complementarity(spark, sf):
    """Accuracy of the kernel block alone and with the window block appended."""
    rows, test = series.vectors(spark, sf), series.is_test(F.col("series_id"))
    base = dictionary.ppv_at_zero(rows, keep=("series_id", "label")).withColumnRenamed("values", "base")
    both = hold(base.join(embedding.embed(rows, "pruned"), "series_id").select("series_id", "label", "base", F.concat("base", "embedding").alias("extended")))
    out = None
    for name in ("base", "extended"):
        part = heads.classify(both.where(~test), both.where(test), name).withColumn("features", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "eval_effective_rank",
    f"WITH {sql.rows(sql.S1)}, c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY t) AS v FROM r), g AS (SELECT a.t AS i, b.t AS j, sum(a.v * b.v) AS g FROM c a JOIN c b USING (id) GROUP BY ALL) SELECT round(sum(CASE WHEN i = j THEN g END)**2 / sum(g * g), 6) AS effective_rank FROM g",
)
def eval_effective_rank(spark, sf):
    return evaluation.effective_rank(series.vectors(spark, sf)).select(F.round("effective_rank", 6).alias("effective_rank"))


# results: suppliers as datasets, line states as methods

_R = "r0 AS (SELECT l_suppkey AS dataset, l_returnflag || l_linestatus AS method, sum(round(l_discount * 100)::BIGINT)::BIGINT AS k, count(*) AS n FROM lineitem GROUP BY ALL), res AS (SELECT dataset, method, ((2000 * k + n) // (2 * n)) / 10000e0 AS accuracy FROM r0)"
_MISSING = f"{_R}, mis AS (SELECT res.* FROM res JOIN r0 USING (dataset, method) WHERE NOT (n < 95 AND method = 'AF'))"
_TIED = f"{_R}, tie AS (SELECT dataset, method, floor(accuracy * 20) / 20 AS accuracy FROM res)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("dataset"), F.concat("l_returnflag", "l_linestatus").alias("method"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    sums = lines.groupBy("dataset", "method").agg(F.sum("d").alias("k"), F.count("*").alias("n"))
    return sums.select("dataset", "method", (F.expr("(2000 * k + n) div (2 * n)") / F.lit(10000.0)).alias("accuracy"), "n")


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).drop("n")


def missing(spark: SparkSession, sf: str) -> DataFrame:
    """Without the cells of one method that have few lines, so that some datasets are incomplete."""
    return _cells(spark, sf).where("NOT (n < 95 AND method = 'AF')").drop("n")


def tied(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf).withColumn("accuracy", F.floor(F.col("accuracy") * 20) / 20)


_PAIR = "p AS (SELECT a.dataset, a.accuracy - b.accuracy AS d FROM {t} a JOIN {t} b USING (dataset) WHERE a.method = 'AF' AND b.method = 'RF')"
_WTL = "count(*) FILTER (d > 1e-9)::BIGINT AS wins, count(*) FILTER (abs(d) <= 1e-9)::BIGINT AS ties, count(*) FILTER (d < -1e-9)::BIGINT AS losses"
add("eval_pair_compare", lambda spark, sf: evaluation.pair(missing(spark, sf), "AF", "RF").withColumn("d", rounded(F.col("d"))), f"WITH {_MISSING}, {_PAIR.format(t='mis')} SELECT dataset, round(d, 6) + 0.0 AS d FROM p")
add(
    "eval_win_tie_loss",
    lambda spark, sf: evaluation.win_tie_loss(evaluation.pair(tied(spark, sf), "AF", "RF")).withColumn("mean_difference", rounded(F.col("mean_difference"))),
    f"WITH {_TIED}, {_PAIR.format(t='tie')} SELECT {_WTL}, round(avg(d), 6) + 0.0 AS mean_difference, count(*)::BIGINT AS n FROM p",
)
for _kind, _frame, _base, _table in (("", missing, _MISSING, "mis"), ("_tied", tied, _TIED, "tie")):
    add(
        f"eval_wilcoxon{_kind}",
        lambda spark, sf, f=_frame: evaluation.signed_rank(evaluation.pair(f(spark, sf), "AF", "RF")).select("w_plus", "w_minus", "n", rounded(F.col("z")).alias("z")),
        f"WITH {_base}, {_PAIR.format(t=_table)}, k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM p WHERE d <> 0), "
        "q AS (SELECT coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus, count(*)::BIGINT AS n, coalesce(sum(t * t - 1), 0) AS tied FROM k) "
        "SELECT w_plus, w_minus, n, CASE WHEN n >= 5 THEN round((least(w_plus, w_minus) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - tied / 48e0), 6) END AS z FROM q",
    )


def _signed_ranks(pairs: str) -> str:
    """CTEs up to sr (a, b, w_plus, w_minus, nz, tied, z) of a table (a, b, dataset, d)."""
    return f"""pp AS ({pairs}), rk0 AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM pp WHERE d <> 0),
s0 AS (SELECT a, b, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus, count(*)::BIGINT AS nz, sum(t * t - 1) AS tied FROM rk0 GROUP BY a, b),
sr AS (SELECT *, (least(w_plus, w_minus) - nz * (nz + 1) / 4e0) / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24e0 - tied / 48e0) AS z FROM s0),
co AS (SELECT a, b, {_WTL}, avg(d) AS mean_difference, count(*)::BIGINT AS n FROM pp GROUP BY a, b)"""


#: How many subsets of the ranks 1..r have each sum: the exact distribution for up to 50 pairs.
_WAYS = "ways AS (SELECT 0 AS r, [1e0] AS w UNION ALL SELECT r + 1, list_transform(range(0, (r + 1) * (r + 2) // 2 + 1), lambda i: coalesce(w[i + 1], 0e0) + CASE WHEN i >= r + 1 THEN coalesce(w[i - r], 0e0) ELSE 0e0 END) FROM ways WHERE r < 50)"
_P = f"CASE WHEN nz <= 50 AND tied = 0 THEN least(1e0, 2 * list_sum(list_slice((SELECT w FROM ways WHERE r = nz), 1, floor(least(w_plus, w_minus))::INT + 1)) / pow(2e0, nz)) ELSE {sql.erfc('greatest(abs(z), 1e-300) / sqrt(2e0)')} END"
_FIRST = "SELECT 'AF' AS a, y.method AS b, x.dataset, x.accuracy - y.accuracy AS d FROM res x JOIN res y USING (dataset) WHERE x.method = 'AF' AND y.method <> 'AF'"


@query("eval_wilcoxon_table", f"WITH RECURSIVE {_WAYS}, {_R}, {_signed_ranks(_FIRST)} SELECT a, b, round({_P}, 6) AS p, wins, ties, losses, n FROM sr JOIN co USING (a, b)")
def eval_wilcoxon_table(spark, sf):
    """Two-sided p-values of every method against the first."""
    held = hold(frame(spark, sf))
    rows = [evaluation.wilcoxon(held, "AF", m) for m in ("AO", "NF", "NO", "RF", "RO")]
    made = spark.createDataFrame([(r["a"], r["b"], r["p"], r["wins"], r["ties"], r["losses"], r["n"]) for r in rows], "a string, b string, p double, wins long, ties long, losses long, n long")
    return made.withColumn("p", F.round("p", 6))


METHODS = ("AF", "AO", "NF", "NO", "RF", "RO")
#: Thirteen of the pairs of methods.
PAIRS = [(a, b) for i, a in enumerate(METHODS) for b in METHODS[i + 1 :]][:13]
_IN_PAIRS = "SELECT x.method AS a, y.method AS b, x.dataset, x.accuracy - y.accuracy AS d FROM mis x JOIN mis y USING (dataset) WHERE x.method < y.method AND x.method || y.method NOT IN ('NORO', 'RFRO')"


@query("eval_pair_table", f"WITH {_MISSING}, {_signed_ranks(_IN_PAIRS)} SELECT a, b, round(mean_difference, 6) + 0.0 AS mean_difference, wins, ties, losses, n, w_plus, w_minus, CASE WHEN nz >= 5 THEN round(z, 6) END AS z FROM sr JOIN co USING (a, b)")
def eval_pair_table(spark, sf):
    """Thirteen pairs of methods at once, datasets without either left out."""
    made = evaluation.pair_table(missing(spark, sf), PAIRS)
    return made.withColumns({"mean_difference": rounded(F.col("mean_difference")), "z": F.round("z", 6)})


_RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY dataset, accuracy) - 1) / 2e0 AS rank FROM {t})"
_COMPLETE = "ful AS (SELECT * FROM {t} WHERE dataset IN (SELECT dataset FROM {t} GROUP BY dataset HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM {t})))"
add("eval_rank_average", lambda spark, sf: evaluation.ranks(tied(spark, sf)), f"WITH {_TIED}, {_RANKED.format(t='tie')} SELECT dataset, method, accuracy, rank FROM rk")
add(
    "eval_rank_ordinal",
    lambda spark, sf: evaluation.ordinal_ranks(tied(spark, sf)),
    f"WITH {_TIED} SELECT dataset, method, accuracy, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(accuracy, -1) DESC, method)::INT AS rank FROM tie",
)
add("eval_complete_cases", lambda spark, sf: evaluation.complete(missing(spark, sf)), f"WITH {_MISSING}, {_COMPLETE.format(t='mis')} SELECT dataset, method, accuracy FROM ful")
add(
    "eval_average_ranks",
    lambda spark, sf: evaluation.average_ranks(missing(spark, sf)).withColumn("mean_rank", F.round("mean_rank", 6)),
    f"WITH {_MISSING}, {_COMPLETE.format(t='mis')}, {_RANKED.format(t='ful')} SELECT method, round(avg(rank), 6) AS mean_rank, count(*)::BIGINT AS n FROM rk GROUP BY method",
)
add(
    "eval_mean_accuracy",
    lambda spark, sf: evaluation.mean_accuracy(tied(spark, sf)).withColumns({"mean_accuracy": F.round("mean_accuracy", 6), "std_accuracy": F.round("std_accuracy", 6)}),
    f"WITH {_TIED}, m AS (SELECT *, max(accuracy) OVER (PARTITION BY dataset) AS best FROM tie) SELECT method, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy, count(*)::BIGINT AS n, count(*) FILTER (accuracy = best)::BIGINT AS wins FROM m GROUP BY method",
)
add(
    "eval_mean_complete",
    lambda spark, sf: evaluation.complete(missing(spark, sf)).groupBy("method").agg(F.round(F.avg("accuracy"), 6).alias("mean_accuracy")),
    f"WITH {_MISSING}, {_COMPLETE.format(t='mis')} SELECT method, round(avg(accuracy), 6) AS mean_accuracy FROM ful GROUP BY method",
)
_FRIEDMAN = f"WITH {_TIED}, {_RANKED.format(t='tie')}, m AS (SELECT method, sum(rank) AS r, count(*) AS n FROM rk GROUP BY method), q AS (SELECT sum(r * r) AS rr, count(*)::DOUBLE AS k, max(n)::DOUBLE AS n FROM m), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM rk GROUP BY dataset, accuracy))"
add(
    "eval_friedman",
    lambda spark, sf: evaluation.friedman(tied(spark, sf)).withColumn("chi2", F.round("chi2", 6)),
    f"{_FRIEDMAN} SELECT round((12 * rr / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))), 6) AS chi2, k::BIGINT AS methods, n::BIGINT AS datasets FROM q, t",
)
_CD = f"WITH {_R}, {_RANKED.format(t='res')}, a AS (SELECT method, avg(rank) AS mean_rank, count(*) AS n FROM rk GROUP BY method), cd AS (SELECT {list(evaluation.Q_05)}[count(*) - 1] * sqrt(count(*) * (count(*) + 1) / (6e0 * max(n))) AS cd, count(*) AS methods, max(n) AS datasets FROM a)"
add("eval_nemenyi_cd", lambda spark, sf: evaluation.critical_difference(frame(spark, sf)).withColumn("cd", F.round("cd", 6)), f"{_CD} SELECT round(cd, 6) AS cd, methods::BIGINT AS methods, datasets::BIGINT AS datasets FROM cd")
add(
    "eval_cliques",
    lambda spark, sf: evaluation.cliques(frame(spark, sf)).withColumns({"first_rank": F.round("first_rank", 6), "last_rank": F.round("last_rank", 6)}),
    f"{_CD}, g AS (SELECT a.method AS m, a.mean_rank AS lo, b.method AS name, b.mean_rank AS hi FROM a, a b, cd WHERE b.mean_rank >= a.mean_rank AND b.mean_rank - a.mean_rank < cd), c AS (SELECT m, min(lo) AS first_rank, max(hi) AS last_rank, string_agg(name, ',' ORDER BY name) AS members, count(*) AS n FROM g GROUP BY m) "
    "SELECT round(first_rank, 6) AS first_rank, round(last_rank, 6) AS last_rank, members FROM c x WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM c y WHERE y.first_rank < x.first_rank AND y.last_rank >= x.last_rank)",
)
_POINTS = f"WITH {_R}, pt AS (SELECT method, (100 * row_number() OVER (ORDER BY method))::INT AS dims, round(avg(accuracy), 6) AS accuracy FROM res GROUP BY method)"


@query("eval_pareto", f"{_POINTS} SELECT method, dims, accuracy FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.dims < p.dims AND q.accuracy >= p.accuracy)")
def eval_pareto(spark, sf):
    from pyspark.sql import Window

    points = frame(spark, sf).groupBy("method").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))
    return evaluation.pareto(points.withColumn("dims", (100 * F.row_number().over(Window.orderBy("method"))).cast("int"))).select("method", "dims", "accuracy")


_COMBINED = f"{_R}, cmb AS (SELECT dataset, CASE method WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'A+x' WHEN 'NF' THEN 'A+y' WHEN 'NO' THEN 'B' WHEN 'RF' THEN 'B+x' ELSE 'B+y' END AS method, accuracy FROM res)"


@query(
    "eval_combination_table",
    f"WITH {_COMBINED}, p AS (SELECT b.method AS base, substr(c.method, 3) AS addition, c.accuracy - b.accuracy AS d FROM cmb b JOIN cmb c ON b.dataset = c.dataset AND c.method LIKE b.method || '+%') SELECT base, addition, round(avg(d), 6) + 0.0 AS gain, {_WTL} FROM p GROUP BY base, addition",
)
def eval_combination_table(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in (("AF", "A"), ("AO", "A+x"), ("NF", "A+y"), ("NO", "B"), ("RF", "B+x"), ("RO", "B+y")) for x in pair])
    renamed = frame(spark, sf).withColumn("method", names[F.col("method")])
    return evaluation.combination_table(renamed, ("A", "B"), ("x", "y")).withColumn("gain", rounded(F.col("gain")))


# five bases with three additions each: lines by number and part
_GRID = "g0 AS (SELECT l_suppkey AS dataset, 'B' || (l_linenumber % 5) || ['', '+x', '+y', '+z'][l_partkey % 4 + 1] AS method, sum(round(l_discount * 100)::BIGINT)::BIGINT AS k, count(*) AS n FROM lineitem GROUP BY ALL), grd AS (SELECT dataset, method, ((2000 * k + n) // (2 * n)) / 10000e0 AS accuracy FROM g0)"


@query(
    "eval_combination_table15",
    f"WITH {_GRID}, p AS (SELECT b.method AS base, substr(c.method, 4) AS addition, c.accuracy - b.accuracy AS d FROM grd b JOIN grd c ON b.dataset = c.dataset AND c.method LIKE b.method || '+%') SELECT base, addition, round(avg(d), 6) + 0.0 AS gain, {_WTL} FROM p GROUP BY base, addition",
)
def eval_combination_table15(spark, sf):
    """Five bases and three additions."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "+x", "+y", "+z")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    method = F.concat(F.lit("B"), (F.col("l_linenumber") % 5).cast("string"), suffix)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("dataset"), method.alias("method"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    sums = lines.groupBy("dataset", "method").agg(F.sum("d").alias("k"), F.count("*").alias("n"))
    grid = sums.select("dataset", "method", (F.expr("(2000 * k + n) div (2 * n)") / F.lit(10000.0)).alias("accuracy"))
    return evaluation.combination_table(grid, [f"B{i}" for i in range(5)], ("x", "y", "z")).withColumn("gain", rounded(F.col("gain")))


GROUPS = {"first": ("AF", "AO", "NF"), "other": ("NO", "RF", "RO", "AF"), "all": METHODS, "too few": ("AF", "AO")}


def _group_sql(name: str, methods: tuple[str, ...]) -> str:
    chosen, k = ", ".join(f"'{m}'" for m in methods), len(methods)
    ranked = f"SELECT method, rank() OVER (PARTITION BY dataset ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY dataset, accuracy) - 1) / 2e0 AS rank FROM mis WHERE method IN ({chosen}) QUALIFY count(*) OVER (PARTITION BY dataset) = {k}"
    return f"SELECT '{name}' AS part, method, round(avg(rank), 6) AS mean_rank, count(*)::BIGINT AS datasets, round({evaluation.Q_05[k - 2]} * sqrt({k} * {k + 1} / (6e0 * count(*))), 6) AS cd FROM ({ranked}) GROUP BY method"


@query("eval_cd_groups", f"WITH {_MISSING} " + " UNION ALL ".join(_group_sql(n, m) for n, m in GROUPS.items() if len(m) > 2))
def eval_cd_groups(spark, sf):
    """Mean ranks and critical difference within named groups of methods, each over its own complete datasets."""
    return evaluation.grouped_ranks(missing(spark, sf), GROUPS).withColumns({"mean_rank": F.round("mean_rank", 6), "cd": F.round("cd", 6)})


add(
    "eval_accuracy_table",
    lambda spark, sf: evaluation.accuracy_table(tied(spark, sf)),
    f"WITH {_TIED}, m AS (SELECT *, accuracy = max(accuracy) OVER (PARTITION BY dataset) AS best FROM tie) SELECT dataset, method, accuracy, best, printf('%.4f', accuracy) || CASE WHEN best THEN ' *' ELSE '' END AS shown FROM m",
)
add(
    "eval_rank_summary",
    lambda spark, sf: evaluation.rank_summary(missing(spark, sf)).withColumns({"mean_rank": F.round("mean_rank", 6), "std_rank": F.round("std_rank", 6)}),
    f"WITH {_MISSING}, c AS (SELECT d.dataset, q.method, mis.accuracy FROM (SELECT DISTINCT dataset FROM mis) d CROSS JOIN (SELECT DISTINCT method FROM mis) q LEFT JOIN mis ON mis.dataset = d.dataset AND mis.method = q.method), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(accuracy, -1) DESC, method) AS rank, accuracy = max(accuracy) OVER (PARTITION BY dataset) AS best FROM c) "
    "SELECT method, round(avg(rank), 6) AS mean_rank, round(stddev_pop(rank), 6) AS std_rank, count(*) FILTER (best)::BIGINT AS wins FROM k GROUP BY method",
)
_PIVOT = ", ".join(f"max(accuracy) FILTER (method = '{m}') AS {m}" for m in ("AF", "AO", "NF", "NO", "RF", "RO"))
add("res_pivot", lambda spark, sf: results.to_wide(missing(spark, sf), ("AF", "AO", "NF", "NO", "RF", "RO")), f"WITH {_MISSING} SELECT dataset, {_PIVOT} FROM mis GROUP BY dataset")
add("res_remaining", lambda spark, sf: results.remaining(frame(spark, sf), missing(spark, sf)), f"WITH {_MISSING} SELECT r.* FROM res r ANTI JOIN mis m ON r.dataset = m.dataset AND r.method = m.method")


@query("res_upsert", f"WITH {_MISSING}, new AS (SELECT dataset, method, CASE WHEN dataset % 3 = 0 THEN NULL ELSE accuracy + 1 END AS v FROM res WHERE method IN ('AF', 'NO')) SELECT coalesce(m.dataset, n.dataset) AS dataset, coalesce(m.method, n.method) AS method, coalesce(n.v, m.accuracy) AS accuracy FROM mis m FULL JOIN new n ON m.dataset = n.dataset AND m.method = n.method")
def res_upsert(spark, sf):
    new = frame(spark, sf).where("method IN ('AF', 'NO')").withColumn("accuracy", F.when(F.col("dataset") % 3 != 0, F.col("accuracy") + 1))
    return results.upsert(missing(spark, sf), new)


add("res_subset", lambda spark, sf: frame(spark, sf).join(spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dataset")), "dataset", "left_semi"), f"WITH {_R} SELECT * FROM res SEMI JOIN (SELECT s_suppkey AS dataset FROM supplier WHERE s_acctbal > 0) USING (dataset)")
add("res_methods", lambda spark, sf: frame(spark, sf).select("method").distinct().orderBy("method"), f"WITH {_R} SELECT DISTINCT method FROM res")
add("res_intersection", lambda spark, sf: frame(spark, sf).where("accuracy < 0.45 AND method <> 'AF'").select("method").intersect(frame(spark, sf).where("accuracy > 0.5").select("method")), f"WITH {_R} SELECT method FROM res WHERE accuracy < 0.45 AND method <> 'AF' INTERSECT SELECT method FROM res WHERE accuracy > 0.5")
add("res_except", lambda spark, sf: frame(spark, sf).select("dataset", "method").exceptAll(missing(spark, sf).select("dataset", "method")), f"WITH {_MISSING} SELECT dataset, method FROM res EXCEPT ALL SELECT dataset, method FROM mis")
add("res_union", lambda spark, sf: frame(spark, sf).where("method = 'AF'").unionByName(frame(spark, sf).where("method LIKE 'R%'")), f"WITH {_R} SELECT * FROM res WHERE method = 'AF' UNION ALL SELECT * FROM res WHERE method LIKE 'R%'")
add(
    "res_smallest_datasets",
    lambda spark, sf: spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("dataset")).agg(F.count("*").alias("size")).orderBy("size", "dataset").limit(12),
    "SELECT l_suppkey AS dataset, count(*)::BIGINT AS size FROM lineitem GROUP BY 1 ORDER BY size, dataset LIMIT 12",
)
add(
    "res_top_gains",
    lambda spark, sf: evaluation.pair(frame(spark, sf), "AF", "RF").withColumn("d", rounded(F.col("d"))).orderBy(F.desc("d"), "dataset").limit(10),
    f"WITH {_R}, {_PAIR.format(t='res')} SELECT dataset, round(d, 6) + 0.0 AS d FROM p ORDER BY d DESC, dataset LIMIT 10",
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 760-column embedding of the vectors with a cross-validated ridge on it: a prediction for each test series."""
    release()
    rows, test = star(spark, sf_dir), series.is_test(F.col("series_id"))
    codes = heads.label_codes(rows.where(~test))
    coded = heads.encode(rows, codes)
    scaler = heads.fit_scaler(rows.where(~test), "values")
    ready = hold(heads.scaled(coded, scaler, "values", "z", ("series_id", "code"), scrub=True))
    model, _ = heads.ridge_cv(ready.where(~test), codes.count())
    return heads.predict(ready.where(test), model, keep=("series_id", "code"))
