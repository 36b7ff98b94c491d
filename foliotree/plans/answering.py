"""Questions → context, references, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliotree.completer import Completer, asks
from foliotree.functions.durable import cut
from foliotree.functions.skew import join_hot
from foliotree.functions.text import truncate
from foliotree.operators.answers import CONTEXT_CHARS, answer, answer_requests, assemble, attach_context, resolve_documents
from foliotree.operators.retrieval import first_pages, indexed_documents, retrieve
from foliotree.operators.tree import tree_text


def page_heads(pages: DataFrame) -> DataFrame:
    """Pages cut to what a context shows of them, so that no join moves more."""
    return pages.withColumn("content", truncate(F.col("content"), CONTEXT_CHARS))


def fallback_context(questions: DataFrame, conversations: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Questions with context and references when no model chooses the pages.

    The first pages depend on the document only: the context is made once per
    document that a conversation is about, handed to those conversations and from
    there to their questions, instead of being made again for every question.
    """
    linked = conversations.select("conversation_id", F.col("document_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    read = indexed_documents(catalog).select("doc_id").join(linked.select("doc_id"), "doc_id", "left_semi")
    per_document = assemble(page_heads(first_pages(pages)).join(read, "doc_id", "left_semi"), "doc_id")
    per_conversation = join_hot(linked, per_document, "doc_id", ["conversation_id"])
    answered = join_hot(questions, per_conversation, "conversation_id", ["question_id"], "left")
    return answered.withColumn("context", F.coalesce("context", F.lit("")))


def question_context(questions: DataFrame, conversations: DataFrame, catalog: DataFrame, nodes: DataFrame,
                     pages: DataFrame, completer: Completer | None = None) -> DataFrame:
    """Questions (question_id, conversation_id, message) with context and references.

    With a model the resolved questions are read again and again (to find hot
    documents, to ask, to attach), so they are made once.
    """
    if not asks(completer):
        return fallback_context(questions, conversations, catalog, pages)
    resolved = cut(resolve_documents(questions, conversations, catalog))
    retrieved = retrieve(resolved.where(F.col("doc_id").isNotNull()), catalog, tree_text(nodes), page_heads(pages), completer)
    return attach_context(resolved.drop("page_count"), assemble(retrieved))


def answer_questions(questions: DataFrame, conversations: DataFrame, catalog: DataFrame, nodes: DataFrame,
                     pages: DataFrame, completer: Completer, answer_completer: Completer | None = None,
                     style: str = "batch") -> DataFrame:
    """(question_id, conversation_id, answer, references) of a batch of questions."""
    asked = answer_requests(question_context(questions, conversations, catalog, nodes, pages, completer), style)
    needed = asked.select("question_id", "conversation_id", "references", "system", "prompt")
    return answer(needed, answer_completer or completer).select("question_id", "conversation_id", "answer", "references")


def answer_messages(answers: DataFrame, now=None) -> DataFrame:
    """Assistant messages of answers, ready to be appended. Questions without an answer are in :func:`failed_answers`."""
    now = F.current_timestamp() if now is None else now
    return answers.where(F.col("answer").isNotNull()).select(
        F.sha2(F.concat_ws("|", F.lit("answer"), F.col("question_id").cast("string")), 256).alias("message_id"),
        "conversation_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), "references",
        now.alias("created_at"),
    )


def failed_answers(answers: DataFrame) -> DataFrame:
    """Questions that got no answer: (question_id, conversation_id, reason)."""
    return answers.where(F.col("answer").isNull()).select("question_id", "conversation_id", F.lit("no answer").alias("reason"))
