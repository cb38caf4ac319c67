"""Session set-up that every operator with Python workers shares."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Rows of an Arrow batch at most: rows may be whole texts, and a worker holds a batch or two.
BATCH_ROWS, _BATCH = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is used from a source checkout, and bound their batches.

    On a cluster the package is installed or shipped with ``--py-files``; the extra path entry
    is then simply absent on the executors.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (tests, a single machine) may leave that
    unset; its warehouse has a folder then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_crossbar_shared"
    path = spark._jvm.org.apache.hadoop.fs.Path(configured.rstrip("/"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
