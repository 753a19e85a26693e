"""Cutting the lineage of iterative operators: through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (in one process only) a temporary one of the session."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="stemspark-")
        shared_folder.own = folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Written by checkpoint(), so that later rounds neither recompute nor replan what came before and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
