"""Taking decisions about rows back to the rows, by id and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.llm.key_filter import flagged, folded


def undecided_and_one_each(docs: DataFrame, id_col: str, digest: Column, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows that were decided against; columns as before, whatever their names.

    ``decided`` is a stored table of distinct ``doc_id, digest, again``: where
    ``again`` is false, all rows of that id (null is an id like others) and
    digest go, where it is true, one of them stays. Rows that it doesn't name
    stay. Rows whose id may be named are joined with it, by a shuffle at every
    size; the others, known by a bounded filter, stay where they are. Repeats are
    reduced before they are shuffled, so any number of them is no large task.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), digest.alias("digest"))
    told = flagged(keyed, folded(decided, F.col("doc_id").cast(docs.schema[id_col].dataType)), "named", F.col("id"))
    open_rows = told.where("named").drop("named")
    named = decided.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), F.col("again").alias("__again"))
    on = lambda d: F.col("id").eqNullSafe(d["__id"]) & (F.col("digest") == d["__d"])
    out = told.where("NOT named").select("row.*").unionByName(open_rows.join(named.hint("merge"), on(named), "left_anti").select("row.*"))
    repeats = named.where("__again")
    if repeats.isEmpty():
        return out
    return out.unionByName(open_rows.join(repeats, on(repeats), "left_semi").dropDuplicates(["id", "digest"]).select("row.*"))
