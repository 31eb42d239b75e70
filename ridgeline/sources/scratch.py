"""Results that are written to the session's checkpoint folder before others are made of them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by the keys, in the checkpoint folder: it is evaluated once, and what follows by these keys is not dealt out again.

    Spark removes the files with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set, else they stay until
    the folder is emptied. Where the session names no folder, one that runs in one process takes a temporary one; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/ridgeline-checkpoints")
    return (df.repartition(*keys) if keys else df).checkpoint()
