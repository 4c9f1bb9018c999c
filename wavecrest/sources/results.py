"""Experiment results as JSON lines: scans, appends, upserts and summaries.

Files hold one object for each dataset with a key for each method, or one for each run.
An upsert never writes over what it reads: it makes a new table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, scores map, errors map) of lines with a key for each method; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = F.from_json("value", "map<string,string>")
    rest = F.map_filter(cells, lambda k, v: k != "dataset")
    scores = F.transform_values(F.map_filter(rest, lambda k, v: ~k.endswith("_err")), lambda k, v: v.try_cast("double"))
    errors = F.map_filter(rest, lambda k, v: k.endswith("_err"))
    return lines.select(cells["dataset"].alias("dataset"), scores.alias("scores"), errors.alias("errors"))


def to_long(wide: DataFrame) -> DataFrame:
    return wide.select("dataset", F.explode("scores").alias("method", "accuracy"))


def to_wide(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """One row for each dataset, a column for each method in the order of names."""
    pivot = results.groupBy("dataset").pivot("method", sorted(methods) if methods else None)
    return pivot.agg(F.max("accuracy"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    schema = "dataset string, config string, n_train int, n_test int, T int, n_classes int, n_features int, feat_time_s double, clf_time_s double, accuracy double, alpha double, best_iteration int, error string"
    return spark.read.schema(schema).json(path).where("dataset IS NOT NULL")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("dataset", "method"), value: str = "accuracy") -> DataFrame:
    """Rows of both; where a key is in both, the new value unless it is null."""
    fresh = new.select(*keys, F.col(value).alias("new__"))
    return old.join(fresh, list(keys), "full_outer").select(*keys, F.coalesce("new__", value).alias(value))


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A list of names, a line each, stripped, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("dataset")).where("dataset <> ''")


def write_summary(results: DataFrame, path: str) -> None:
    """One JSON object: number of datasets, methods, and each method's mean rank and accuracy."""
    from wavecrest.operators.evaluation import mean_accuracy, ordinal_ranks

    means = mean_accuracy(results).select("method", "mean_accuracy")
    ranks = ordinal_ranks(results).groupBy("method").agg(F.avg("rank").alias("mean_rank"))
    each = means.join(ranks, "method").orderBy("mean_rank").agg(F.collect_list(F.struct("method", "mean_rank", "mean_accuracy")).alias("m"))
    entries = lambda name: F.map_from_entries(F.transform("m", lambda r: F.struct(r["method"], r[name])))
    total = results.agg(F.count_distinct("dataset").alias("n_datasets"))
    row = each.crossJoin(total).select("n_datasets", F.transform("m", lambda r: r["method"]).alias("configs"), entries("mean_rank").alias("avg_ranks"), entries("mean_accuracy").alias("mean_accuracy"))
    row.coalesce(1).write.mode("overwrite").json(path)
