"""Scanning files, admitting them, and turning text files into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliotree.functions.text import base_name, file_ext
from foliotree.operators.catalog import PENDING

# Accepted file types, and the largest accepted size (50 MiB).
FILE_TYPES = [".pdf", ".docx", ".txt", ".md"]
TEXT_TYPES = [".txt", ".md"]
MAX_FILE_SIZE = 52_428_800


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file below ``path``. The bytes are read only if a later step selects ``content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return named(reader.load(path))


def named(files: DataFrame) -> DataFrame:
    return files.select(
        "path", base_name(F.col("path")).alias("name"), "length",
        F.col("modificationTime").alias("modified_at"), "content",
    )


def reject_reason(name: Column, length: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """Why a file is refused, null if it is not. The type is judged before the size."""
    return F.when(~F.coalesce(file_ext(name).isin(FILE_TYPES), F.lit(False)), F.lit("unsupported file type")).when(
        length > max_size, F.lit("file too large")
    ).when(length.isNull(), F.lit("unknown file size"))


def admit(files: DataFrame, max_size: int = MAX_FILE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason).

    The size test is repeated as a plain predicate so that it reaches the file
    source, which then never opens an oversized file.
    """
    judged = files.withColumn("file_type", file_ext(F.col("name"))).withColumn(
        "reason", reject_reason(F.col("name"), F.col("length"), max_size)
    )
    accepted = judged.where(F.col("length") <= max_size).where(F.col("reason").isNull()).drop("reason")
    rejected = judged.where(F.col("reason").isNotNull()).select("name", "length", "file_type", "reason")
    return accepted, rejected


def document_id() -> Column:
    """Id of a scanned file version: the same file gives the same id when a job is run again."""
    return F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modified_at").cast("string")), 256)


def register(accepted: DataFrame, now: Column | None = None) -> DataFrame:
    """Catalog rows of admitted files, status pending and no pages yet."""
    now = F.current_timestamp() if now is None else now
    return accepted.select(
        document_id().alias("doc_id"),
        "name",
        F.col("path").alias("file_path"),
        "file_type",
        F.col("length").alias("file_size"),
        F.lit(0).alias("page_count"),
        F.lit(PENDING).alias("index_status"),
        F.lit(False).alias("has_tree"),
        F.lit(None).cast("string").alias("error_message"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8 with universal newlines for text files; invalid bytes give a null text and an error."""
    raw = F.col(content).cast("string")
    is_text, valid = F.col("file_type").isin(TEXT_TYPES), F.is_valid_utf8(raw)
    return df.withColumn("text", F.when(is_text & valid, F.regexp_replace(raw, "\r\n?", "\n"))).withColumn(
        "error_message", F.when(is_text & ~valid, F.lit("the file is not valid UTF-8"))
    )


def with_decoder_columns(decoded: DataFrame) -> DataFrame:
    """Add the columns that decoders of PDF and DOCX files fill, null where there was none.

    The decoders themselves are not part of this package. A PDF or DOCX file
    without decoded content is an error of that document.
    """
    kinds = {"rich_text": "string", "raw_pages": "array<string>", "paragraphs": "array<string>"}
    for name, kind in kinds.items():
        if name not in decoded.columns:
            decoded = decoded.withColumn(name, F.lit(None).cast(kind))
    empty = F.when(F.col("file_type") == ".pdf", F.col("rich_text").isNull() & F.col("raw_pages").isNull()).when(
        F.col("file_type") == ".docx", F.col("paragraphs").isNull()
    ).otherwise(F.lit(False))
    undecoded = F.when(empty, F.lit("the file was not decoded"))
    return decoded.withColumn("error_message", F.coalesce("error_message", undecoded))
