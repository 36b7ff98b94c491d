"""Questions × documents → pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.completer import Completer, asks
from foliotree.functions.durable import cut, stored
from foliotree.functions.skew import SMALL_ROWS, hot_keys, join_hot, shuffle_width
from foliotree.functions.text import (
    json_array_span, strip_think, variant_kind, variant_text, with_strict_json,
)
from foliotree.operators.summaries import SYSTEM
from foliotree.sources.layout import slice_of

# Ranges or pages per question, and the reason given for fallback pages.
TOP_K = 5
FALLBACK_REASON = "Content page"

RETRIEVAL_PROMPT = (
    "Choose the page ranges of the document that are needed to answer the question, the most useful first.\n"
    'Reply as [{"page_start": number, "page_end": number, "reason": text}].\n\n'
)

RETRIEVED_COLUMNS = ("question_id", "doc_id", "rank", "page", "content", "reason", "char_count")


def with_index(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions (question_id, doc_id, …) whose document has a tree, with its page count."""
    return join_hot(questions, indexed_documents(catalog), "doc_id", ["question_id"])


def indexed_documents(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("has_tree")).select("doc_id", "page_count")


def retrieval_requests(questions: DataFrame, tree_texts: DataFrame) -> DataFrame:
    """R2: add system and prompt from the question and its document's tree text.

    ``tree_texts`` (doc_id, tree_text, …) may bring further columns of the document.
    """
    prompt = F.concat(F.lit(RETRIEVAL_PROMPT), F.lit("Question: "), "message", F.lit("\n\nDocument:\n"), "tree_text")
    return (
        join_hot(questions, tree_texts, "doc_id", ["question_id"])
        .withColumn("system", F.lit(SYSTEM))
        .withColumn("prompt", prompt)
        .drop("tree_text", "message")
    )


_PICK = "struct<rank:int,page_start:bigint,page_end:bigint,reason:string>"


def decode_ranges(responses: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Add ``ranges``: the first ``top_k`` ranges in rank order, null where the question falls back.

    One element that is no object, or has a page that is no whole number, spoils
    all of them; elements after the first ``top_k`` are not looked at. A valid
    empty list stays an empty list.
    """
    parsed = with_strict_json(responses, json_array_span(strip_think(F.col("response"))), "__list")
    taken = parsed.withColumn("__taken", F.slice(F.col("__list").try_cast("array<variant>"), 1, top_k))

    def page(item, name, default):
        v = F.try_variant_get(item, f"$.{name}", "variant")
        whole = variant_kind(v).isin("BIGINT", "BOOLEAN")
        return F.when(v.isNull(), default).when(whole, F.try_variant_get(v, "$", "bigint"))

    def pick(item, i):
        first = page(item, "page_start", F.lit(1).cast("bigint"))
        reason = F.try_variant_get(item, "$.reason", "variant")
        picked = F.struct(
            (i + 1).cast("int").alias("rank"), first.alias("page_start"), page(item, "page_end", first).alias("page_end"),
            F.when(reason.isNull(), F.lit("")).otherwise(variant_text(reason)).alias("reason"),
        )
        return F.when(variant_kind(item) == "OBJECT", picked.cast(_PICK))

    picks = taken.withColumn("__picks", F.transform("__taken", pick))
    sound = F.forall(
        "__picks", lambda r: r.isNotNull() & r["page_start"].isNotNull() & r["page_end"].isNotNull()
    )
    return picks.withColumn("ranges", F.when(sound, F.col("__picks"))).drop("__list", "__taken", "__picks")


def explode_ranges(decoded: DataFrame) -> DataFrame:
    """Ranges as rows (question_id, doc_id, page_count, rank, page_start, page_end, reason)."""
    return decoded.select("question_id", "doc_id", "page_count", F.inline_outer("ranges")).where(F.col("rank").isNotNull())


def ranges_to_pages(ranges: DataFrame, pages: DataFrame, small: bool = False) -> DataFrame:
    """The existing non-empty pages of each range, in (rank, page) order, overlaps repeated.

    A range is first cut to 1..page_count, then listed: that yields just the pages
    it will return, joined on (document, page). A range condition beside the
    document key would instead compare every range with every page of its document.
    ``small`` says that the pages wanted are few (at most SMALL_ROWS): then their
    keys are sent to the pages, and the corpus is not shuffled for a handful of
    questions.
    """
    first = F.greatest(F.col("page_start"), F.lit(1).cast("bigint"))
    last = F.least(F.col("page_end"), F.col("page_count").cast("bigint"))
    wanted = (
        ranges.where(first <= last)
        .select("question_id", "doc_id", "rank", "reason", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("page"))
        .withColumn("__page_key", F.struct("doc_id", "page"))
    )
    bodies = pages.where(F.col("content") != "").select(
        F.struct("doc_id", F.col("page_number").alias("page")).alias("__page_key"), "content", "char_count"
    )
    if small:
        bodies = bodies.join(F.broadcast(wanted.select("__page_key").distinct()), "__page_key", "left_semi")
    return join_hot(wanted, bodies, "__page_key", ["question_id", "rank"]).select(*RETRIEVED_COLUMNS)


def _clustered(pages: DataFrame) -> bool:
    """Whether pages come from the layout that is bucketed by document and slice."""
    return "page_slice" in pages.columns


def _join_slices(wanted: DataFrame, pages: DataFrame, which: Column) -> DataFrame:
    """Rows wanted (doc_id, slice, …) with the non-empty pages of their slice for which ``which`` holds.

    Pages stay in their buckets; what is wanted is dealt out to them. Documents
    that hold more than their share of what is wanted are joined apart, where
    their rows are spread and only their pages are moved.
    """
    bodies = pages.where(F.col("content") != "").select("doc_id", "page_slice", "page_number", "content", "char_count")
    hot = stored(hot_keys(wanted, "doc_id", shuffle_width(wanted)).select("doc_id"), "hot")
    if hot.isEmpty():
        return wanted.join(bodies, ["doc_id", "page_slice"]).where(which)
    plain = wanted.join(F.broadcast(hot), "doc_id", "left_anti").join(bodies, ["doc_id", "page_slice"])
    key = F.struct("doc_id", "page_slice")
    asked = wanted.join(F.broadcast(hot), "doc_id", "left_semi").withColumn("__key", key)
    held = bodies.join(F.broadcast(hot), "doc_id", "left_semi").withColumn("__key", key).drop("doc_id", "page_slice")
    return plain.unionByName(join_hot(asked, held, "__key", ["question_id", "rank"]).drop("__key")).where(which)


def ranges_to_slices(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """R4 on the bucketed layout: a range is listed by its slices, and joined with the pages of each that it covers."""
    first = F.greatest(F.col("page_start"), F.lit(1).cast("bigint"))
    last = F.least(F.col("page_end"), F.col("page_count").cast("bigint"))
    wanted = ranges.where(first <= last).select(
        "question_id", "doc_id", "rank", "reason", first.alias("first"), last.alias("last"),
        F.explode(F.sequence(slice_of(first), slice_of(last))).alias("page_slice"))
    found = _join_slices(wanted, pages, F.col("page_number").between(F.col("first"), F.col("last")))
    return found.withColumnRenamed("page_number", "page").select(*RETRIEVED_COLUMNS)


def first_pages(pages: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The document half of R5: first ``top_k`` pages, then the empty ones dropped.

    Page numbers count from 1 without gaps, so the first pages are a filter that
    reaches the Parquet scan of stored pages.
    """
    return pages.where(F.col("page_number") <= top_k).where(F.col("content") != "").select(
        "doc_id", F.col("page_number").alias("rank"), F.col("page_number").alias("page"), "content",
        F.lit(FALLBACK_REASON).alias("reason"), "char_count",
    )


def fallback_pages(questions: DataFrame, pages: DataFrame, top_k: int = TOP_K, small: bool = False) -> DataFrame:
    """The first pages of each question's document. ``small`` as in :func:`ranges_to_pages`, of the questions."""
    if _clustered(pages):
        wanted = questions.select("question_id", "doc_id", F.lit(0).alias("rank"), F.explode(F.sequence(F.lit(0), slice_of(F.lit(top_k)))).alias("page_slice"))
        found = _join_slices(wanted, pages.where(F.col("page_number") <= top_k), F.lit(True))
        return found.withColumns({"rank": F.col("page_number"), "page": F.col("page_number"), "reason": F.lit(FALLBACK_REASON)}).select(*RETRIEVED_COLUMNS)
    asked, heads = questions.select("question_id", "doc_id"), first_pages(pages, top_k)
    if small:
        heads = heads.join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    return join_hot(asked, heads, "doc_id", ["question_id"]).select(*RETRIEVED_COLUMNS)


def choose_branch(decoded: DataFrame, pages: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Pages of the ranges where they are usable, else of the fallback, per question.

    ``decoded`` is read several times and should be a stored table: it is counted
    first, to see whether few pages are wanted.
    """
    usable, rest = decoded.where(F.col("ranges").isNotNull()), decoded.where(F.col("ranges").isNull())
    ranges = explode_ranges(usable)
    first, last = F.greatest(F.col("page_start"), F.lit(1)), F.least(F.col("page_end"), F.col("page_count"))
    listed = ranges.where(first <= last).agg(F.sum(last - first + 1)).first()[0] or 0
    picked = ranges_to_pages(ranges, pages, small=True) if listed <= SMALL_ROWS else (
        ranges_to_slices if _clustered(pages) else ranges_to_pages)(ranges, pages)
    few_left = rest.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return picked.unionByName(fallback_pages(rest, pages, top_k, small=few_left))


def retrieve(questions: DataFrame, catalog: DataFrame, tree_texts: DataFrame, pages: DataFrame,
             completer: Completer | None = None, top_k: int = TOP_K) -> DataFrame:
    """Retrieved pages of many questions (question_id, doc_id, message).

    What depends on the document only is joined per document first, so that the
    questions, among which one document may be asked about very often, are joined
    once. Without a model nothing is asked, and neither tree texts nor prompts are
    made. With one, the decoded ranges have several readers and are cut off from
    the plan that made them.
    """
    indexed = indexed_documents(catalog)
    if not asks(completer):
        if _clustered(pages):
            return fallback_pages(join_hot(questions.select("question_id", "doc_id"), indexed.select("doc_id"), "doc_id", ["question_id"], "left_semi"), pages, top_k)
        read = indexed.select("doc_id").join(questions.select("doc_id"), "doc_id", "left_semi")
        return fallback_pages(questions, pages.join(read, "doc_id", "left_semi"), top_k)
    asked = retrieval_requests(questions.select("question_id", "doc_id", "message"), tree_texts.join(indexed, "doc_id"))
    decoded = decode_ranges(completer.attach(asked), top_k)
    return choose_branch(cut(decoded.select("question_id", "doc_id", "page_count", "ranges")), pages, top_k)
