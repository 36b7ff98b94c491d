"""Large tables that change by little: appended files, tombstones, and compaction of touched files only.

    <path>/files/<number>       rows added by one version, clustered by key
    <path>/gone/<number>        keys deleted by one version
    <path>/versions/<number>    the manifest: every file with its rows and the range of its columns

A version is there when its manifest is; readers of an older one are not
disturbed, and nothing is overwritten in place. Files that no manifest names
any longer can be removed once no reader needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliotree.functions.durable import stored
from foliotree.functions.skew import SMALL_ROWS
from foliotree.sources.tables import folders

_FILE, _GONE, _COMMIT = "file", "gone", "commit"
_ADDED = "__version"


class VersionedTable:
    """One writer at a time. Rows hang on ``key``; ``id_col`` tells repeated rows apart, if the table has such a column.

    ``place`` are columns that a row with the same id always has again (a replayed
    message has its conversation and its time): repeats of a row are sought only
    in files whose ranges of these columns meet those of the new rows. Files are
    clustered by ``order``, ``files`` at a time or as many as Spark finds right.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, id_col: str | None = None,
                 place: tuple[str, ...] = (), order: tuple[str, ...] = (), files: int | None = None) -> None:
        self.files = files
        self.spark, self.path, self.key, self.id_col = spark, path, key, id_col
        self.place = tuple(dict.fromkeys((key, *place)))
        self.order = order or (key,)

    # Versions

    def latest(self) -> int:
        """Number of the newest version, -1 if there is none."""
        return max(map(int, folders(self.spark, f"{self.path}/versions")), default=-1)

    def manifest(self, number: int | None = None) -> DataFrame:
        """``kind, name, file, rows, low, high`` of a version; commits have a row without a file."""
        number = self.latest() if number is None else number
        if number < 0:
            raise ValueError(f"there is no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/versions/{number:08d}")

    def _put(self, number: int, manifest: DataFrame) -> None:
        # A second writer of the same number fails here.
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/{number:08d}")

    def _described(self, kind: str, name: str, folder: str, columns: tuple[str, ...]) -> DataFrame:
        """Manifest rows of the files in a folder; only ``columns`` are read."""
        read = self.spark.read.parquet(folder)
        low, high = [F.struct(*[f(c).alias(c) if c in columns else F.lit(None).cast(self._type(c)).alias(c) for c in self.place]) for f in (F.min, F.max)]
        files = read.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), low.alias("low"), high.alias("high"))
        return files.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "file", "rows", "low", "high")

    def _type(self, column: str) -> str:
        return self._schema[column].dataType.simpleString()

    def _commit_row(self, name: str) -> DataFrame:
        none = F.struct(*[F.lit(None).cast(self._type(c)).alias(c) for c in self.place])
        return self.spark.range(1).select(F.lit(_COMMIT).alias("kind"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("file"),
                                          F.lit(0).cast("bigint").alias("rows"), none.alias("low"), none.alias("high"))

    def _written(self, number: int, rows: DataFrame) -> str:
        """The folder of rows that are stored for a version, clustered; a hot key is cut into several files."""
        folder = f"{self.path}/files/{number:08d}"
        dealt = rows.repartitionByRange(self.files, *self.order) if self.files else rows.repartitionByRange(*self.order)
        dealt.sortWithinPartitions(*self.order).write.mode("overwrite").parquet(folder)
        return folder

    @property
    def _schema(self):
        """Columns of the table, and the version that added a row."""
        if not hasattr(self, "_known_schema"):
            first = f"{self.path}/files/{min(folders(self.spark, f'{self.path}/files'))}"
            self._known_schema = self.spark.read.parquet(first).schema
        return self._known_schema

    # Reading

    def _files(self, manifest: DataFrame, kind: str, where: Column | None = None) -> list[str]:
        """Paths of a manifest's files, as Spark itself holds them for any scan."""
        rows = manifest.where((F.col("kind") == kind) & (F.col("rows") > 0))
        return [r.file for r in (rows if where is None else rows.where(where)).select("file").collect()]

    def _scan(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*files)

    def _tombstones(self, manifest: DataFrame) -> DataFrame | None:
        """``key, __until``: rows of the key are gone that were added before that version. Broadcast only if it is known to be small."""
        files = self._files(manifest, _GONE)
        if not files:
            return None
        gone = self.spark.read.parquet(*files).groupBy(self.key).agg(F.max(_ADDED).alias("__until"))
        n = manifest.where(F.col("kind") == _GONE).agg(F.sum("rows")).first()[0]
        return F.broadcast(gone) if n <= SMALL_ROWS else gone

    def _alive(self, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        if gone is None:
            return rows
        named = gone.withColumnRenamed(self.key, "__gone")
        return rows.join(named, (F.col(self.key) == F.col("__gone")) & (F.col(_ADDED) < F.col("__until")), "left_anti")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default: its files without what its tombstones delete."""
        manifest = self.manifest(number)
        return self._alive(self._scan(self._files(manifest, _FILE)), self._tombstones(manifest)).drop(_ADDED)

    # Changes

    def _has(self, manifest: DataFrame, name: str) -> bool:
        return not manifest.where((F.col("kind") == _COMMIT) & (F.col("name") == name)).isEmpty()

    def create(self, rows: DataFrame, name: str = "create") -> None:
        """The first version."""
        self._written(0, rows.withColumn(_ADDED, F.lit(0).cast("bigint")))
        files = self._described(_FILE, name, f"{self.path}/files/{0:08d}", self.place)
        self._put(0, files.unionByName(self._commit_row(name)))

    def _near(self, manifest: DataFrame, fresh: DataFrame) -> DataFrame:
        """The files whose ranges meet those of all new rows together, one row; a new row without a place may repeat one of any file."""
        bounds = fresh.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in self.place for n, f in (
            ("low", F.min), ("high", F.max), ("none", lambda x: F.max(x.isNull())))])
        meets = F.lit(True)
        for c in self.place:
            inside = (F.col(f"low.{c}") <= F.col(f"high_{c}")) & (F.col(f"high.{c}") >= F.col(f"low_{c}"))
            meets = meets & (F.coalesce(inside, F.lit(True)) | F.col(f"none_{c}"))
        return manifest.join(F.broadcast(bounds), meets, "left_semi")

    def append(self, rows: DataFrame, name: str) -> bool:
        """Add rows; false, and nothing done, if a batch of this name was added before.

        Rows whose id is in the table, or twice in the batch, count once; rows
        without an id are all added. Old rows are read only for their ids, and only
        from files that may hold one of the new ones, so the time goes with those
        and not with the table. A deleted row may come back.
        """
        number, manifest = self.latest() + 1, self.manifest()
        if self._has(manifest, name):
            return False
        fresh = rows
        if self.id_col:
            named = F.col(self.id_col).isNotNull()
            fresh = stored(rows.where(named).dropDuplicates([self.id_col]).unionByName(rows.where(~named)), "append")
            old = self._alive(self._scan(self._files(self._near(manifest, fresh), _FILE)), self._tombstones(manifest)).select(self.id_col)
            known = old.join(fresh.select(self.id_col), self.id_col, "left_semi").distinct()
            fresh = fresh.join(known, self.id_col, "left_anti")
        columns = [c for c in self._schema.names if c != _ADDED]
        folder = self._written(number, fresh.select(*columns).withColumn(_ADDED, F.lit(number).cast("bigint")))
        self._put(number, manifest.unionByName(self._described(_FILE, name, folder, self.place)).unionByName(self._commit_row(name)))
        return True

    def delete(self, keys: DataFrame, name: str) -> bool:
        """Delete all rows of the keys of a table that has the key column. Only the keys are written; readers leave their rows out."""
        number, manifest = self.latest() + 1, self.manifest()
        if self._has(manifest, name):
            return False
        folder = f"{self.path}/gone/{number:08d}"
        gone = keys.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self._type(self.key)).alias(self.key)).distinct()
        gone.withColumn(_ADDED, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(folder)
        self._put(number, manifest.unionByName(self._described(_GONE, name, folder, (self.key,))).unionByName(self._commit_row(name)))
        return True

    def compact(self) -> list[str]:
        """Rewrite the files that hold a deleted row, and no others; the tombstones are done with. Returns the files replaced.

        Files whose range of the key meets no tombstone are not opened; of the
        others only the key is read to see which hold a deleted row.
        """
        number, manifest = self.latest() + 1, self.manifest()
        gone = self._tombstones(manifest)
        if gone is None:
            return []
        bounds = manifest.where(F.col("kind") == _GONE).agg(F.min(f"low.{self.key}").alias("low"), F.max(f"high.{self.key}").alias("high")).first()
        replaced: list[str] = []
        if bounds.low is not None:
            near = self._files(manifest, _FILE, (F.col(f"low.{self.key}") <= F.lit(bounds.high)) & (F.col(f"high.{self.key}") >= F.lit(bounds.low)))
            held = self._scan(near).select(F.col("_metadata.file_path").alias("file"), self.key, _ADDED) if near else None
            if held is not None:
                named = gone.withColumnRenamed(self.key, "__gone")
                hits = held.join(named, (F.col(self.key) == F.col("__gone")) & (F.col(_ADDED) < F.col("__until")), "left_semi")
                replaced = sorted(r.file for r in hits.select("file").distinct().collect())
        kept = manifest.where((F.col("kind") != _GONE) & ~F.coalesce(F.col("file").isin(replaced), F.lit(False)))
        if replaced:
            folder = self._written(number, self._alive(self._scan(replaced), gone))
            kept = kept.unionByName(self._described(_FILE, f"compact-{number}", folder, self.place))
        self._put(number, kept)
        return replaced


def changed_tables(spark: SparkSession, path: str) -> dict[str, VersionedTable]:
    """The tables of an index and its conversations, each under ``path``."""
    kinds = {
        "catalog": VersionedTable(spark, f"{path}/catalog", "doc_id", "doc_id"),
        "doc_pages": VersionedTable(spark, f"{path}/doc_pages", "doc_id", order=("doc_id", "page_number")),
        "page_summaries": VersionedTable(spark, f"{path}/page_summaries", "doc_id", order=("doc_id", "page_number")),
        "nodes": VersionedTable(spark, f"{path}/nodes", "doc_id", order=("doc_id", "path")),
        "conversations": VersionedTable(spark, f"{path}/conversations", "conversation_id", "conversation_id"),
        "messages": VersionedTable(spark, f"{path}/messages", "conversation_id", "message_id", ("created_at",), ("conversation_id", "created_at")),
    }
    return kinds


def delete_documents(tables: dict[str, VersionedTable], ids: DataFrame, name: str) -> None:
    """C11 by tombstones: the documents listed (doc_id) with all that hangs on them, also their conversations and messages.

    What is written are ids; a run that broke off is run again under its name. The
    messages go first and the catalog last, so what is left of a broken run is still found.
    """
    gone = stored(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "gone")
    if "conversations" in tables:
        talks = tables["conversations"].read()
        of_documents = stored(talks.join(gone, talks["document_id"] == gone["doc_id"], "left_semi").select("conversation_id"), "gone-conversations")
        for table in ("messages", "conversations"):
            if table in tables:
                tables[table].delete(of_documents, name)
    for table in sorted(set(tables) - {"conversations", "messages"}, key=lambda t: (t == "catalog", t)):
        tables[table].delete(gone, name)


def delete_conversations(tables: dict[str, VersionedTable], ids: DataFrame, name: str) -> None:
    """C10 by tombstones."""
    gone = stored(ids.select("conversation_id").distinct(), "gone")
    for table in ("messages", "conversations"):
        tables[table].delete(gone, name)
