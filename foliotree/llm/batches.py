"""Sizes of the Arrow batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound a worker's batch by rows and bytes: ten thousand long texts at once would not fit into a small executor.

    Settings that are lower already stay.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
