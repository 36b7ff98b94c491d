"""One layout of pages, summaries and nodes: rows that are joined lie in the same bucket.

Pages and summaries are bucketed by document and slice (``SLICE_PAGES`` page
numbers), nodes by document. A join or a grouping on these columns reads the
buckets as they lie, without an exchange; only the other side of a join, the
questions, is dealt out to them. A document of very many pages is spread over the
buckets by its slices, and no page has to be repeated for it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_PAGES = 64

# By which columns a table is dealt to buckets, and how a bucket is sorted.
BUCKETED = {
    "doc_pages": (("doc_id", "page_slice"), ("doc_id", "page_slice", "page_number")),
    "page_summaries": (("doc_id", "page_slice"), ("doc_id", "page_slice", "page_number")),
    "nodes": (("doc_id",), ("doc_id", "path")),
}
_LAYOUT = "name string, buckets int, columns string"


def slice_of(page: Column) -> Column:
    return F.floor((page - 1) / SLICE_PAGES).cast("int")


def _table_name(path: str, name: str) -> str:
    return f"clustered_{name}_{hashlib.sha256(f'{path}/{name}'.encode()).hexdigest()[:16]}"


def save_clustered(tables: dict[str, DataFrame], path: str, buckets: int) -> None:
    """Write the tables named in ``BUCKETED`` to new directories ``path/<name>``, one file a bucket.

    ``buckets`` should be about as many as a join of the pages would have
    partitions; it is a property of the stored tables.
    """
    for name, df in tables.items():
        by, order = BUCKETED[name]
        rows = df.withColumn("page_slice", slice_of(F.col("page_number"))) if "page_slice" in by else df
        table = _table_name(path, name)
        (rows.repartition(buckets, *by).write.mode("errorifexists").bucketBy(buckets, *by).sortBy(*order[:2])
         .option("path", f"{path}/{name}").format("parquet").saveAsTable(table))
        layout = [(name, buckets, rows.schema.toDDL())]
        df.sparkSession.createDataFrame(layout, _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/{name}")


def open_clustered(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of :func:`save_clustered`, with their buckets, also in another session than the one that wrote them."""
    out = {}
    for name, buckets, columns in spark.read.schema(_LAYOUT).parquet(f"{path}/layout/*").collect():
        table, (by, order) = _table_name(path, name), BUCKETED[name]
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet
            CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order[:2])}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'""")
        out[name] = spark.table(table)
    return out
