"""Exact deduplication by content-defined chunk recipes.

A text (white space normalised) is cut where its own content says so, so equal
passages give equal chunks wherever they stand. Chunks are deduplicated by
content to verified identifiers: a chunk is named by its hash and, where
different contents share a hash, by its place among them. A document is then
the ordered list of its chunk identifiers, and documents are equal when their
lists are. Contents move once, as distinct chunks; all later steps move lists
of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliotree.functions.durable import stored
from foliotree.llm.keep import undecided_and_one_each

BLANKS = r"[\x20\x09-\x0D]+"
MIN_CHUNK, MAX_CHUNK = 512, 8192
# What stands before a cut: in prose of Latin letters every few hundred code points, so that two texts that differ
# in front soon cut at the same places again. Scripts without it are cut every MAX_CHUNK code points.
CUT = "[a-h][n-z][a-m][ .,][a-h]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def chunk_pattern(low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> str:
    """A chunk: from ``low`` code points on up to the first cut, at most ``high``; the rest of a text is one, too."""
    return rf"(?s).{{{low},{high - 1}}}?(?<={CUT})|.{{1,{high}}}"


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The chunks in order; together they are the text. No chunk for an empty text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(low, high)), F.lit(0))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                low: int = MIN_CHUNK, high: int = MAX_CHUNK, hash_of=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts are empty; all empty texts are equal. The smallest id of a group
    stays. A null id never is the smallest: only a group of null ids alone has a
    null ``keep_id``, and its rows are ``kept``. Repeated rows (same id, same
    text) are counted in ``group_size`` and share their flag. No rows give no
    rows. Other columns of ``docs`` are not read. ``hash_of`` is a parameter so
    that tests can make hashes collide.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    hashes = F.transform(F.col("chunk"), lambda c: hash_of(c))
    cutted = read.withColumn("chunk", chunks(F.col("text"), low, high))
    recipes = stored(cutted.select("doc_id", F.sha2("text", 256).alias("text_sha256"), hashes.alias("recipe")), "recipes")

    # Distinct chunk contents, combined before the shuffle. Grouping by the content itself is what verifies them.
    contents = (
        read.select(F.explode_outer(chunks(F.col("text"), low, high)).alias("content")).where("content IS NOT NULL")
        .select(hash_of(F.col("content")).alias("h"), "content").groupBy("h", "content").agg(F.count("*").alias("n"))
    )
    identified = stored(contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h"), "collisions")
    if identified.isEmpty():
        ids = recipes.withColumn("list", F.col("recipe"))
    else:
        ids = _with_verified_ids(read, recipes, identified, low, high, hash_of)
    groups = ids.groupBy("list").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    named = ids.join(groups.withColumnRenamed("list", "l"), F.col("list") == F.col("l"))
    return named.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_verified_ids(read: DataFrame, recipes: DataFrame, collisions: DataFrame, low: int, high: int, hash_of) -> DataFrame:
    """Recipes whose shared hashes are followed by the place of the content among those of the hash.

    Only the chunks of colliding hashes are moved. Documents that hold them are
    told apart by their digest too, which keeps the join narrow.
    """
    parts = (
        read.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("text"), low, high)).alias("pos", "content"))
        .where("content IS NOT NULL").withColumn("h", hash_of(F.col("content"))).join(collisions, "h", "left_semi").distinct()
    )
    places = (
        parts.select("h", "content").distinct()
        .withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("content")).cast("long"))
    )
    told = (
        parts.join(places, ["h", "content"]).groupBy("text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "place"))).alias("places"))
        .select("text_sha256", F.flatten(F.transform("places", lambda p: F.array(p["pos"].cast("long"), p["place"]))).alias("places"))
    )
    none = F.array().cast("array<bigint>")
    return recipes.join(told, "text_sha256", "left").withColumn(
        "list", F.concat("recipe", F.lit([0]).cast("array<bigint>"), F.coalesce("places", none))
    ).drop("places")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts, one of the smallest id; columns as before.

    Rows are told apart by id and text, so a row goes or stays by its own text
    where ids are shared. Of rows that share both, and of rows without an id
    whose text no id has, one stays. The decisions are a stored table: Spark
    broadcasts it if it is small and shuffles otherwise.
    """
    rows = deduplicate(docs, id_col, text_col).groupBy("doc_id", F.col("text_sha256").alias("digest"), "kept").agg(F.count("*").alias("n"))
    decided = stored(rows.where("NOT kept OR n > 1").select("doc_id", "digest", F.col("kept").alias("again")), "decided")
    return undecided_and_one_each(docs, id_col, F.sha2(normalised(F.col(text_col)), 256), decided)
