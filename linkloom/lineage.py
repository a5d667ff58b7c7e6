"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, on a local master only.

    From here on each query's shuffle files go when it ends: what later queries
    read lies in this folder.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The rows, computed once and kept where all executors can read them."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
