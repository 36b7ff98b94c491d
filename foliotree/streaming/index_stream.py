"""L1: index files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliotree.completer import Completer
from foliotree.functions.durable import stored
from foliotree.operators.catalog import INDEXING, READY
from foliotree.plans.indexing import Index, store_index
from foliotree.sources.files import admit, decode_text, document_id, named, register, with_decoder_columns
from foliotree.sources.log import UpsertLog

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


Decode = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, decoded rows) of admitted files. Of the admitted types only text can be decoded here."""
    decoded = decode_text(files.select(document_id().alias("doc_id"), "file_type", "content")).drop("content")
    return register(files), with_decoder_columns(decoded)


Announce = Callable[[DataFrame], None]


def index_files(files: DataFrame, path: Callable[[str], str], completer: Completer | None = None, announce: Announce | None = None) -> None:
    """Admit, register, decode and index named files into directories ``path(table)``; ``announce`` gets the catalog rows beforehand."""
    accepted, rejected = admit(files)
    rejected.write.mode("overwrite").parquet(path("rejected"))
    catalog, decoded = decode_files(accepted)
    if announce:
        announce(catalog)
    store_index(catalog, decoded, path, completer)


# The current state of a streamed index

def catalog_log(spark: SparkSession, out: str) -> UpsertLog:
    """The log of status changes: one commit when a batch begins to be indexed, one when it is done."""
    return UpsertLog(spark, f"{out}/catalog_log", "doc_id", ("batch", "step"), largest=("indexed",))


def _changes(catalog: DataFrame, batch_id: int, step: int) -> DataFrame:
    """Catalog rows as changes. ``indexed`` is the batch that holds a document's pages and tree, with their number."""
    batch = F.lit(batch_id).cast("bigint")
    ready = F.col("index_status") == READY if step else F.lit(False)
    return catalog.withColumns({"batch": batch, "step": F.lit(step), "indexed": F.when(ready, F.struct(batch.alias("batch"), "page_count"))})


def current_catalog(spark: SparkSession, out: str) -> DataFrame:
    """C13 under a stream: one row per document, from its newest batch, whatever was replayed and in whatever order.

    ``index_batch`` is the batch with its pages and tree. A document that failed
    or is being indexed once more still has those of the batch before.
    """
    rows = catalog_log(spark, out).current()
    return rows.withColumns({
        "page_count": F.coalesce("indexed.page_count", "page_count"), "has_tree": F.col("indexed").isNotNull(),
        "index_batch": F.col("indexed.batch"),
    }).drop("batch", "step", "indexed")


def current_index(spark: SparkSession, out: str) -> Index:
    """The catalog and the pages, summaries and nodes that its rows stand for.

    A batch's rows of a document count if the catalog names that batch. The pairs
    of document and batch that don't are narrow and few, so they are taken away
    from the large tables, which are not moved for the others' sake.
    """
    catalog = stored(current_catalog(spark, out), "catalog")
    pair = ["doc_id", "batch"]
    handed = spark.read.parquet(f"{out}/catalog").select("doc_id", F.col("batch").cast("bigint").alias("batch"))
    outdated = stored(handed.join(catalog.select("doc_id", F.col("index_batch").alias("batch")), pair, "left_anti"), "outdated")

    def live(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{out}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
        return rows.join(outdated, pair, "left_anti").drop("batch")

    return Index(catalog.drop("index_batch"), live("doc_pages"), live("page_summaries"), live("nodes"))


def _start(stream: DataFrame, index: Callable[[DataFrame, Callable[[str], str], Announce], None], out: str, checkpoint: str,
           compact_every: int) -> StreamingQuery:
    """Run ``index`` on every batch, into ``out/<table>/batch=<n>``, and tell the catalog's log before and after.

    A batch that is run again after a failure overwrites its own directories and
    nothing else, and its changes are logged once. After every ``compact_every``
    batches the log is one commit again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = catalog_log(spark, out)

        def path(table: str) -> str:
            return f"{out}/{table}/batch={batch_id}"

        index(batch, path, lambda catalog: log.commit(f"{batch_id:012d}-0-begun", _changes(catalog.withColumn("index_status", F.lit(INDEXING)), batch_id, 0)))
        log.commit(f"{batch_id:012d}-1-done", _changes(spark.read.parquet(path("catalog")), batch_id, 1))
        if (batch_id + 1) % compact_every == 0:
            log.compact(f"{batch_id:012d}-2-compact")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_index(spark: SparkSession, path: str, out: str, checkpoint: str, completer: Completer | None = None,
                 max_files: int | None = None, compact_every: int = 50) -> StreamingQuery:
    """Index every new file below ``path`` once.

    Document ids depend on the file only, so after any replay the tables hold
    each file once. See :func:`current_catalog` and :func:`current_index`.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return _start(reader.load(path), lambda batch, to, announce: index_files(named(batch), to, completer, announce), out, checkpoint, compact_every)


def stream_index_documents(stream: DataFrame, decode: Decode, out: str, checkpoint: str,
                           completer: Completer | None = None, compact_every: int = 50) -> StreamingQuery:
    """The same for a stream of documents that ``decode`` turns into catalog rows and decoded rows.

    A document that comes again in a later batch is indexed again; the current
    tables hold its newest successful pages and tree.
    """
    def index(batch: DataFrame, to: Callable[[str], str], announce: Announce) -> None:
        catalog, decoded = decode(batch)
        announce(catalog)
        store_index(catalog, decoded, to, completer)

    return _start(stream, index, out, checkpoint, compact_every)
