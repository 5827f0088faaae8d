"""Cutting long plans off in the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of its own only where that is unset on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tremora-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: computed once, safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int = 200_000, mb: int = 64) -> bool:
    """Whether df has at most so many rows and about so many MB."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= rows and (held or 0) <= mb << 20


def bounded(df: DataFrame, rows: int = 200_000, mb: int = 64) -> DataFrame:
    """df with a broadcast hint if it fits; else Spark joins by a shuffle."""
    return F.broadcast(df) if fits(df, rows, mb) else df
