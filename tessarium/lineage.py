"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _prepare(spark: SparkSession) -> None:
    """Only where no folder is set and all runs on this machine a temporary one is made; elsewhere executors would write to their own disks, so that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that the driver and all executors share: that of ``spark.checkpoint.dir`` or of setCheckpointDir()."""
    _prepare(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the same one; it's left to its owner to delete."""
    _prepare(spark)
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
