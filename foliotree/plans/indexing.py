"""Documents → pages, summaries, tree nodes and catalog status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.completer import Completer
from foliotree.functions.durable import cut, stored
from foliotree.functions.skew import shuffle_width
from foliotree.functions.text import doc_title
from foliotree.operators.catalog import PENDING, READY, apply_status, mark_indexing
from foliotree.operators.pagers import PagerRegistry, default_registry, page_counts
from foliotree.operators.summaries import page_summaries
from foliotree.operators.tree import build_tree, plan_trees, tree_errors
from foliotree.session import plain_unions
from foliotree.sources.layout import save_clustered


@dataclass
class Index:
    catalog: DataFrame
    doc_pages: DataFrame
    page_summaries: DataFrame
    nodes: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"catalog": self.catalog, "doc_pages": self.doc_pages,
                "page_summaries": self.page_summaries, "nodes": self.nodes}


def title(title_from: str = "stored") -> Column:
    """Title of a catalog row. Stored files are called by their id, so the default title is the id;
    ``title_from="name"`` takes the stem of the uploaded name."""
    if title_from == "name":
        return doc_title(F.col("name"))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("Untitled"))


def titles(catalog: DataFrame, title_from: str = "stored") -> DataFrame:
    return catalog.select("doc_id", title(title_from).alias("title"))


def parse_documents(decoded: DataFrame, registry: PagerRegistry = default_registry) -> tuple[DataFrame, DataFrame]:
    """(pages, parse errors) of decoded rows (doc_id, file_type, text, …, error_message); narrow."""
    bad = decoded.where(F.col("error_message").isNotNull()).select("doc_id", "error_message")
    pages, unknown = registry.paginate(decoded.where(F.col("error_message").isNull()).drop("error_message"))
    return pages, bad.unionByName(unknown)


def index_pages(catalog: DataFrame, handed: DataFrame, pages: DataFrame, parse_errors: DataFrame, summaries: DataFrame,
                completer: Completer | None = None, title_from: str = "stored") -> tuple[DataFrame, DataFrame]:
    """(catalog after indexing, nodes) of the documents handed in (doc_id); all others keep their row.

    Shuffles page counts, summary lines and page heads, never whole pages.
    """
    plain_unions(catalog.sparkSession)
    own = catalog.join(handed.select("doc_id").distinct(), "doc_id", "left_semi")
    parsed = own.select("doc_id").join(parse_errors, "doc_id", "left_anti")
    docs = page_counts(parsed, pages).join(titles(own, title_from), "doc_id")
    planned = plan_trees(docs, summaries, completer)
    errors = parse_errors.unionByName(tree_errors(planned))
    results = docs.select("doc_id", "page_count").join(errors, "doc_id", "full").select(
        "doc_id", F.col("error_message").isNull().alias("success"), "page_count", "error_message"
    )
    return apply_status(catalog, results), build_tree(planned, pages)


def build_index(catalog: DataFrame, decoded: DataFrame, completer: Completer | None = None,
                registry: PagerRegistry = default_registry, title_from: str = "stored") -> Index:
    """Index those catalog documents that have decoded rows, as one lazy plan. Documents without one are left alone."""
    pages, parse_errors = parse_documents(decoded, registry)
    summaries = page_summaries(pages, completer)
    indexed, nodes = index_pages(catalog, decoded, pages, parse_errors, summaries, completer, title_from)
    return Index(indexed, pages, summaries, nodes)


def reindex(index: Index, decoded: DataFrame, completer: Completer | None = None, registry: PagerRegistry = default_registry,
            title_from: str = "stored") -> Index:
    """Index anew the pending documents that have decoded rows, and replace their pages, summaries and nodes.

    They are marked as indexing before anything is built. A document that fails
    keeps the pages and the tree that it had, beside its error. The ids are a
    stored table, so that its size, and not the whole tables', decides the joins.
    """
    pending = index.catalog.where(F.col("index_status") == PENDING).select("doc_id")
    ids = stored(pending.join(decoded.select("doc_id").distinct(), "doc_id", "left_semi"), "reindex")
    fresh = build_index(mark_indexing(index.catalog, ids), decoded.join(ids, "doc_id", "left_semi"), completer, registry, title_from)
    catalog = cut(fresh.catalog)
    done = stored(catalog.where(F.col("index_status") == READY).select("doc_id").join(ids, "doc_id", "left_semi"), "reindexed")

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(done, "doc_id", "left_anti").unionByName(new.join(done, "doc_id", "left_semi"))

    return Index(catalog, replaced(index.doc_pages, fresh.doc_pages), replaced(index.page_summaries, fresh.page_summaries),
                 replaced(index.nodes, fresh.nodes))


def store_index(catalog: DataFrame, decoded: DataFrame, path: Callable[[str], str], completer: Completer | None = None,
                registry: PagerRegistry = default_registry, title_from: str = "stored", clustered: str | None = None,
                buckets: int | None = None) -> None:
    """Index documents into Parquet directories ``path(table)``.

    With ``clustered`` (a new directory) pages, summaries and nodes are also laid
    out in ``buckets`` for questions that come again and again, see
    :mod:`foliotree.sources.layout`; without a number there are as many as shuffle partitions.

    Each stage is written before the next one reads it. So files are opened and
    decoded once, and the decoded rows lie in a directory per file type, where
    every pager reads its own types and columns only; the model is asked once for
    a summary; and the loss of an executor costs at most the running stage.
    """
    spark = catalog.sparkSession

    def written(name: str, df: DataFrame, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(path(name))
        return spark.read.schema(df.schema).parquet(path(name))

    handed = written("decoded", decoded, "file_type")
    pages, errors = parse_documents(handed, registry)
    pages = written("doc_pages", pages)
    summaries = written("page_summaries", page_summaries(pages, completer))
    indexed, nodes = index_pages(catalog, handed, pages, errors, summaries, completer, title_from)
    nodes = written("nodes", nodes)
    written("catalog", indexed)
    if clustered:
        save_clustered({"doc_pages": pages, "page_summaries": summaries, "nodes": nodes}, clustered, buckets or shuffle_width(pages))
