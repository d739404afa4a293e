"""Session defaults and reliable checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "kindred", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | extra).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what the context was given. Only a local session may go without; it gets a temporary one, which goes when the process ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError(f"spark.checkpoint.dir names no shared folder, and a folder of this machine can't be read by the executors of {sc.master}")
            named = tempfile.mkdtemp(prefix="kindred-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; else as it is, for a shuffled join. df should be cut off its lineage, for it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
