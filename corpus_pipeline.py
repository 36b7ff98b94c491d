"""From raw documents to packed sequences: five stages over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; its result is stored as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliotree.functions.durable import new_folder
from foliotree.llm import chunk_dedup, minmax_dedup, mixing, packing, quality
from foliotree.llm.queries import vocabulary


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the documents it gets."""
    return quality.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the smallest id."""
    return chunk_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return minmax_dedup.kept_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights by whole and fractional repetitions."""
    return mixing.copies(mixing.mix(docs, mixing.cyclic_weights, keep=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", clean), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

# Signatures, trained weights and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
