"""Session defaults.

Only local sessions (tests, bench) are built here; on a cluster the caller's
session is used as it comes.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    root = str(Path(__file__).resolve().parents[1])
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    for threads in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(threads, "1")
    session = (
        SparkSession.builder.master(master)
        .appName("wavecrest")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
