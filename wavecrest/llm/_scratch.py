"""Intermediate tables in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local
master (tests) uses a folder under ``/tmp/checkpoints``; on a cluster, where that would be
each executor's own disk, it is an error. Tables are Parquet,
so a lost executor never loses an intermediate result, and lineage is cut. A frame that
an operator returns may read its tables until Python ends; then they are removed.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints/wavecrest"


def shared_folder(spark: SparkSession) -> str:
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not set_to and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_to or LOCAL_DEFAULT).rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def readable(spark: SparkSession, path: str) -> str:
    """The path as executors' Python can open it: with its scheme, and local ones in the form file:///."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()
    return f"file:///{full.removeprefix('file:').lstrip('/')}" if full.startswith("file:") else full


class Scratch:
    """Names, writes and removes the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        atexit.register(_forget, spark, self.base)

    def path(self, label: str) -> str:
        self.made.append(f"{self.base}/{label}-{len(self.made)}")
        return self.made[-1]

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df and returns what reads it back."""
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables made by cut() that nothing reads any more."""
        for table in tables:
            for file in table.inputFiles()[:1]:
                for path in self.made:
                    if f"/{path.rsplit('/', 2)[-2]}/{path.rsplit('/', 1)[-1]}/" in file:
                        delete_path(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """Writes the operator's small result and deletes everything else at once."""
        out = self.cut(df, "result")
        keep = self.made[-1]
        for path in self.made[:-1]:
            delete_path(self.spark, path)
        self.made = [keep]
        return out


def _forget(spark: SparkSession, base: str) -> None:
    """Removes what one call left behind, when Python ends."""
    if base.startswith("file:"):
        shutil.rmtree(base.removeprefix("file:"), ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        delete_path(spark, base)
