"""Reliable storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set already, or, in local mode, one of our own; a cluster must set it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinlake-"))
    return folder or sc.getCheckpointDir()


#: Rows of one task of an exchange whose rows are known before.
TASK_ROWS = 250_000


def parts_for(df: DataFrame) -> int:
    """Partitions of an exchange of a table, by its rows, so that a task's memory doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history, in checkpoint storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
