"""Cutting the lineage of iterative queries with reliable checkpoints, in the session's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the one set already; in local mode alone a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        there = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if there is None and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        spark.sparkContext.setCheckpointDir(there or tempfile.mkdtemp(prefix="quarrylens-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or held.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
