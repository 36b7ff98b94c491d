"""A batch of chat requests: conversations, user messages, answers, assistant messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.completer import Completer
from foliotree.functions.durable import cut
from foliotree.operators.catalog import append_messages, get_or_create
from foliotree.plans.answering import answer_messages, answer_questions, failed_answers
from foliotree.streaming.chunk_stream import finished_messages


@dataclass
class Chat:
    messages: DataFrame
    conversations: DataFrame
    new_messages: DataFrame
    rejected: DataFrame
    failed: DataFrame


def user_messages(requests: DataFrame, now: Column) -> DataFrame:
    return requests.select(
        F.sha2(F.concat_ws("|", F.lit("question"), F.col("question_id").cast("string")), 256).alias("message_id"),
        "conversation_id", F.lit("user").alias("role"), F.col("message").alias("content"),
        F.lit(None).cast("array<struct<page:int,reason:string,preview:string>>").alias("references"), now.alias("created_at"),
    )


def chat_batch(requests: DataFrame, conversations: DataFrame, messages: DataFrame, catalog: DataFrame, nodes: DataFrame,
               pages: DataFrame, completer: Completer, answer_completer: Completer | None = None, style: str = "batch",
               now: Column | None = None) -> Chat:
    """Requests (question_id, conversation_id, document_id, message) → the tables after answering them.

    Ids of new conversations and messages are derived from ``question_id``, so a
    batch that is run again makes the same rows. A request whose answer fails is
    undone: neither its message nor the conversation that it opened is kept, and it
    is listed in ``failed``, as one for an unknown conversation is in ``rejected``.
    The resolved requests, the answers and the new messages are stored, since
    several later steps read each of them. An answer comes a microsecond after its
    question, which keeps them in order within a conversation.
    """
    now = F.current_timestamp() if now is None else now
    resolved, created, rejected = get_or_create(requests, conversations, style, now)
    resolved, created = cut(resolved), cut(created)
    answers = cut(answer_questions(
        resolved.select("question_id", "conversation_id", "message"), conversations.unionByName(created), catalog, nodes, pages,
        completer, answer_completer, style,
    ))
    return _recorded(resolved, created, answers, messages, conversations, rejected, failed_answers(answers), now)


def _recorded(resolved: DataFrame, created: DataFrame, answers: DataFrame, messages: DataFrame, conversations: DataFrame,
              rejected: DataFrame, failed: DataFrame, now: Column) -> Chat:
    """The tables after the answered requests. ``answers`` without an answer leave nothing."""
    done = answers.where(F.col("answer").isNotNull()).select("question_id")
    kept = resolved.join(done, "question_id", "left_semi")
    opened = created.join(kept.select("conversation_id"), "conversation_id", "left_semi")
    later = now + F.expr("INTERVAL 0.000001 SECOND")
    new = cut(user_messages(kept, now).unionByName(answer_messages(answers, later)))
    all_messages, touched = append_messages(messages, conversations.unionByName(opened), new)
    return Chat(all_messages, touched, new, rejected, failed)


def chat_stream(requests: DataFrame, parts: DataFrame, contexts: DataFrame, conversations: DataFrame, messages: DataFrame,
                now: Column | None = None) -> Chat:
    """The end of a streamed chat: stored parts of the answers become messages with their references.

    ``parts`` is what :func:`~foliotree.streaming.chunk_stream.stream_fold_chunks`
    has stored, its ``message_id`` being the question's; ``contexts``
    (question_id, references) is what the questions were answered from. A request
    counts once its answer is whole; a broken-off one is ``failed``; one that is
    still under way is in no table and comes with a later run. What an earlier run
    has recorded stays as it is, since ids are derived from the question.
    """
    now = F.current_timestamp() if now is None else now
    resolved, created, rejected = get_or_create(requests, conversations, "stream", now)
    resolved, created = cut(resolved), cut(created)
    finished, broken = finished_messages(parts)
    texts = finished.select(F.col("message_id").alias("question_id"), F.col("content").alias("answer"))
    answers = cut(resolved.select("question_id", "conversation_id").join(texts, "question_id")
                  .join(contexts.select("question_id", "references"), "question_id", "left"))
    failed = resolved.select("question_id", "conversation_id").join(
        broken.select(F.col("message_id").alias("question_id"), F.col("error_message").alias("reason")), "question_id")
    return _recorded(resolved, created, answers, messages, conversations, rejected, failed, now)
