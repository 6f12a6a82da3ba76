"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset, which is an error unless Spark runs on one machine."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    path = context.getConf().get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
    if not set_.isDefined():
        context.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
