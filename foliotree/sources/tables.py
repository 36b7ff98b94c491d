"""Derived tables on shared storage.

A table directory is written once and never overwritten in place: a mutation
writes its result to a new directory, and the reader is pointed there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Order in which each table is clustered; the leading column is what it is looked up by.
CLUSTERING = {
    "doc_pages": ("doc_id", "page_number"),
    "page_summaries": ("doc_id", "page_number"),
    "nodes": ("doc_id", "path"),
    "messages": ("conversation_id", "created_at"),
}


def save(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Write tables as Parquet, clustered by their look-up key.

    Range partitioning over (key, position) cuts a document that holds a large
    share of the pages into several files, which hash partitioning or bucketing
    on the key alone would not, and leaves tight min/max statistics for lookups.
    """
    for name, df in tables.items():
        keys = [k for k in CLUSTERING.get(name, ()) if k in df.columns]
        if keys:
            df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
            df = df.sortWithinPartitions(*keys)
        df.write.mode(mode).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


# Input up to this size may be dealt out anew; anything larger stays as it is read.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal a small scan out over the cores by the hash of a unique ``key``; leave a large one alone.

    A small file of one row group is one task whatever the cluster. What is moved
    is at most ``SPREAD_BYTES``, by the size that the planner knows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, F.xxhash64(*key)) if size <= SPREAD_BYTES else df


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose table is complete, in order; none if there is no such path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
