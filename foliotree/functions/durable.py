"""Cutting lineage in storage that survives the loss of an executor."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder will do for a local master only: the
    executors of a cluster would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="foliotree-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, so that what follows never runs it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like :func:`cut`, as a Parquet table: columns are pruned when it is read, and its true size is known to the planner."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
