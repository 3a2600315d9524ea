"""State that outlives a step: written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it has none, one in its warehouse, which executors share too.

    Where driver and executors are one process, a new temporary folder does.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path and re.match(r"local(\[|$)", sc.master):
        path = tempfile.mkdtemp(prefix="spark-")
    elif not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, written: what made them isn't run again, also if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
