"""From retrieved pages to prompt context, references, answers and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.completer import Completer
from foliotree.functions.skew import join_hot
from foliotree.functions.text import strip, truncate

# Characters of a page in the context and in a reference, and the tags of a reasoning block.
CONTEXT_CHARS = 1500
PREVIEW_CHARS = 200
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"

# What stands around the page number before a page in the context.
PAGE_HEADER = ("\n\n[Page ", "]\n")

# Chunks in one part of a folded message.
PART_CHUNKS = 4096

ANSWER_SYSTEM = {
    "batch": (
        "You answer questions about documents, relying on what the document says and naming the pages used. "
        "Where the question is about categories or tables, give the criterion, every category with its definition, "
        "the table or section it stands in, and how the categories relate."
    ),
    "stream": "You answer questions about documents, relying on what the document says.",
}
ANSWER_CLOSE = {
    "batch": "Answer from the document above; be exact about criteria and relations of categories.",
    "stream": "Answer from the document above.",
}


def resolve_documents(questions: DataFrame, conversations: DataFrame, catalog: DataFrame) -> DataFrame:
    """A1: questions (question_id, conversation_id, message) with the ``doc_id`` to read, or null.

    A document counts only if it exists and has a tree. Documents are resolved
    per conversation first, so the many questions are joined once.
    """
    indexed = catalog.where(F.col("has_tree")).select("doc_id", "page_count")
    linked = conversations.select("conversation_id", F.col("document_id").alias("doc_id"))
    readable = join_hot(linked.where(F.col("doc_id").isNotNull()), indexed, "doc_id", ["conversation_id"])
    return join_hot(questions, readable, "conversation_id", ["question_id"], "left")


def _gather(retrieved: DataFrame, key: str, chars: int) -> DataFrame:
    """Pages of a key in (rank, page) order, cut to ``chars`` before the shuffle."""
    cut = retrieved.select(key, "rank", "page", "reason", truncate(F.col("content"), chars).alias("head"))
    return cut.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "page", "reason", "head"))).alias("__rows")
    )


def _context() -> Column:
    before, after = map(F.lit, PAGE_HEADER)
    return F.array_join(F.transform("__rows", lambda r: F.concat(before, r["page"].cast("string"), after, r["head"])), "")


def _references(n: int) -> Column:
    return F.transform("__rows", lambda r: F.struct(
        r["page"].alias("page"), r["reason"].alias("reason"), F.substring(r["head"], 1, n).alias("preview")))


def build_context(retrieved: DataFrame, n: int = CONTEXT_CHARS, key: str = "question_id") -> DataFrame:
    """A2: prompt context per key, pages in retrieval order."""
    return _gather(retrieved, key, n).select(key, _context().alias("context"))


def build_references(retrieved: DataFrame, n: int = PREVIEW_CHARS, key: str = "question_id") -> DataFrame:
    """A3: references per key; a question without pages has no row, which a left join turns into null."""
    return _gather(retrieved, key, n).select(key, _references(n).alias("references"))


def assemble(retrieved: DataFrame, key: str = "question_id") -> DataFrame:
    """A2 and A3 in one aggregation. ``key`` may be doc_id, for pages that depend on the document only."""
    return _gather(retrieved, key, CONTEXT_CHARS).select(
        key, _context().alias("context"), _references(PREVIEW_CHARS).alias("references")
    )


def attach_context(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions with ``context`` ('' if none) and ``references`` (null if none)."""
    return questions.join(contexts, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def answer_requests(questions: DataFrame, style: str = "batch") -> DataFrame:
    """A4: add system and prompt to questions (message, context); earlier messages are not part of it."""
    question = F.concat(F.lit("Question: "), F.col("message"))
    with_context = F.concat(F.lit("Document:"), F.col("context"), F.lit("\n\n"), question, F.lit("\n\n" + ANSWER_CLOSE[style]))
    return questions.withColumn("system", F.lit(ANSWER_SYSTEM[style])).withColumn(
        "prompt", F.when(F.col("context") != "", with_context).otherwise(question)
    )


def answer(requests: DataFrame, completer: Completer) -> DataFrame:
    """A5: one completion per question, as it comes."""
    return completer.attach(requests).withColumnRenamed("response", "answer")


def kept_chunk(chunk: Column) -> Column:
    """Chunks with a think tag and blank chunks are dropped, text between tags in other chunks is not."""
    tagged = chunk.contains(THINK_OPEN) | chunk.contains(THINK_CLOSE)
    return ~tagged & (strip(chunk) != "")


def filter_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(kept_chunk(F.col("chunk")))


def fold_chunks(chunks: DataFrame, part_chunks: int = PART_CHUNKS) -> DataFrame:
    """Chunks (message_id, seq, chunk) → (message_id, content), one row per message. Replayed rows count once.

    Chunks are joined to parts of ``part_chunks`` sequence numbers first, so that
    the chunks of a long message are spread, and then the parts to the message.
    """
    return join_parts(_fold_parts(chunks, part_chunks))


def join_parts(parts: DataFrame) -> DataFrame:
    """Messages (message_id, content) of their parts (message_id, part, content), each part there once."""
    return parts.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: p["content"]), "").alias("content")
    )


def _fold_parts(chunks: DataFrame, part_chunks: int) -> DataFrame:
    part = F.floor(F.col("seq") / part_chunks).cast("int")
    once = F.array_sort(F.collect_set(F.struct("seq", "chunk")))
    return (
        chunks.select("message_id", part.alias("part"), "seq", "chunk")
        .groupBy("message_id", "part")
        .agg(F.array_join(F.transform(once, lambda c: c["chunk"]), "").alias("content"))
    )
