"""A table under a stream: a log of committed batches, of which the newest row per key counts.

    <path>/rows/<commit>      the rows of one commit
    <path>/commits/<commit>   its record, written when the rows are there

Rows without a record are not seen, and a commit that has a record is not made
again, so a batch may be replayed at any point. What is newest is said by the
rows themselves (``order``), so batches may come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from foliotree.sources.tables import folders

_RECORD = "name string, replaces array<string>, row_schema string"


class UpsertLog:
    """One writer at a time. ``key`` names a row, the largest ``order`` of a key's rows is the newest (ties: the later name of a commit).

    ``gone`` names a boolean column that marks a key as deleted, if there is one.
    Of the columns ``largest`` the current row has the largest value that any row
    of its key ever had.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: tuple[str, ...], gone: str | None = None, largest: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.key, self.order, self.gone, self.largest = spark, path, key, order, gone, largest

    def _records(self) -> dict[str, tuple[list[str], str]]:
        """Of each commit what it replaces and its schema. There are as many as commits since the log began."""
        names = folders(self.spark, f"{self.path}/commits")
        if not names:
            return {}
        rows = self.spark.read.schema(_RECORD).parquet(*[f"{self.path}/commits/{n}" for n in names]).collect()
        return {r.name: (r.replaces, r.row_schema) for r in rows}

    def live(self) -> list[str]:
        """The commits that are not part of a later one."""
        records = self._records()
        return sorted(set(records) - {n for replaced, _ in records.values() for n in replaced})

    def _write(self, name: str, rows: DataFrame, replaces: list[str]) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
        self.spark.createDataFrame([(name, replaces, rows.schema.json())], _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def commit(self, name: str, rows: DataFrame) -> bool:
        """Add rows under a name that tells the batch; false, and nothing done, if that name is there already."""
        if name in self._records():
            return False
        self._write(name, rows.withColumn("__commit", F.lit(name)), [])
        return True

    def _newest(self) -> DataFrame | None:
        """The newest row of every key, deleted ones too; combined before the shuffle, so a key of very many rows is no large group."""
        records, live = self._records(), self.live()
        if not live:
            return None
        import json

        rows = None
        by_schema: dict[str, list[str]] = {}
        for name in live:
            by_schema.setdefault(records[name][1], []).append(f"{self.path}/rows/{name}")
        for schema, paths in by_schema.items():
            part = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        columns = [c for c in rows.columns if c not in self.largest]
        newest = rows.groupBy(self.key).agg(
            F.max_by(F.struct(*columns), F.struct(*self.order, "__commit")).alias("__row"), *[F.max(c).alias(c) for c in self.largest])
        return newest.select("__row.*", *self.largest)

    def current(self) -> DataFrame:
        """One row per key that is not deleted. A log without commits has no columns to return and is an error."""
        newest = self._newest()
        if newest is None:
            raise ValueError(f"nothing was committed to {self.path}")
        alive: Column = ~F.coalesce(F.col(self.gone), F.lit(False)) if self.gone else F.lit(True)
        return newest.where(alive).drop("__commit", *([self.gone] if self.gone else []))

    def compact(self, name: str) -> bool:
        """Put the newest rows into one commit that replaces all others.

        Deleted keys stay marked, so an older row that comes late does not bring one back.
        """
        if name in self._records():
            return False
        live, newest = self.live(), self._newest()
        if newest is not None:
            self._write(name, newest, live)
        return newest is not None
