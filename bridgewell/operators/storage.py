"""Rows written to the session's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names. Without one a session on one machine gets a folder of its own; on a cluster
    that would be lost with its machine, so it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="bridgewell-"))


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and read from there: what follows does not derive them again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
