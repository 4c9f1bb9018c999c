"""The corpus pipeline: five stages over `documents`, each written before the next reads it.

1. quality: documents whose empirical-Bayes posterior is below 0.5 go.
2. lines: repeated lines go from the texts; n_chars follows.
3. near_duplicates: of each group (five-word shingles, similarity 0.8) the smallest id stays.
4. decontaminate: documents that hold a benchmark item go.
5. mixing: every column of the remaining documents, domain posteriors, the rate at which each is
   drawn and, of it, the whole number of copies (`draws`). No document leaves here: one with no draws stays, marked by them.

Rows that repeat a doc_id stay or go together in stage 3; rows without one are judged row
by row. Columns that documents has beyond its own go along untouched, whatever their
names (the last stage's own columns replace columns of equal names). An empty table passes through all stages.

SQL cannot express stages 1 and 5 (fitted models) nor the third's components at this
size, so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm import decontaminate, lines, mixing, neardup, quality
from wavecrest.llm._lists import without
from wavecrest.llm._scratch import Scratch

ORACLE_SQL = None


def _shield(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but doc_id and text under names that no operator uses, and those names."""
    names = {c: c if c in ("doc_id", "text") else f"column_{k}__" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _unshield(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    safe, names = _shield(docs)
    kept = quality.score(safe, labels, host=names["source"], path=names["lang"]).where(F.col("posterior__") >= quality.KEEP_FROM)
    return _unshield(kept, names)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, names = _shield(docs)
    out, changed = lines.dedup_lines(safe), F.col("n_dropped") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in names:
        n = names["n_chars"]
        out = out.withColumn(n, F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return _unshield(out, names)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, names = _shield(docs)
    gone = neardup.near_duplicates(safe, width=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("row"))
    # only texts that may go shuffle
    return _unshield(without(safe, gone, F.col("doc_id").cast("long")), names)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, names = _shield(docs)
    mixed = mixing.mix(safe, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=safe.columns)
    # the stage's own columns take the place of equal names
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items() if c not in mixing.MADE], *mixing.MADE)


STAGES = [
    ("quality", stage_quality),
    ("lines", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
