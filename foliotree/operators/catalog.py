"""Reads and changes of the document catalog and the conversation tables.

Changes return new tables; see :mod:`foliotree.sources.tables` for storing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.functions.durable import stored
from foliotree.functions.skew import SMALL_ROWS, join_hot

# Length of a conversation title, and the mark of a cut one.
TITLE_CHARS = 50
ELLIPSIS = "..."

# States of a document.
PENDING, INDEXING, READY, ERROR = "pending", "indexing", "ready", "error"


def _matching(df: DataFrame, key: str, wanted) -> DataFrame:
    """Rows whose ``key`` is ``wanted``: one value, or a DataFrame with a column ``key`` of many."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    return df.where(F.col(key) == F.lit(wanted))


def _counted(keys: DataFrame) -> tuple[DataFrame, bool]:
    """A stored table of keys, and whether it is small enough to be sent to the rows instead of moving them."""
    table = stored(keys, "keys")
    return table, table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _joined(rows: DataFrame, keys: DataFrame, small: bool, key: str, id_col: str, how: str) -> DataFrame:
    """A semi or anti join with distinct keys: where the rows are, or by a shuffle that splits hot keys."""
    return rows.join(F.broadcast(keys), key, how) if small else join_hot(rows, keys, key, [id_col], how)


# Documents

def list_documents(catalog: DataFrame) -> DataFrame:
    """Newest first, without error messages. The total is ``catalog.count()``."""
    return catalog.drop("error_message").orderBy(F.desc("created_at"), F.desc("doc_id"))


def get_document(catalog: DataFrame, doc_id) -> DataFrame:
    """The document with this id, or no row; also the documents of a DataFrame of ids."""
    return _matching(catalog, "doc_id", doc_id).drop("error_message")


def index_status(catalog: DataFrame, doc_id=None) -> DataFrame:
    """Status and error message of one document, or of all."""
    rows = catalog if doc_id is None else _matching(catalog, "doc_id", doc_id)
    return rows.select("doc_id", F.col("index_status").alias("status"), "error_message")


def ready_documents(catalog: DataFrame) -> DataFrame:
    """C4."""
    return catalog.where(F.col("index_status") == READY)


def _touched(catalog: DataFrame, changed: Column, now: Column | None) -> DataFrame:
    """Every change of a document's row moves its ``updated_at``, if the table has one."""
    if "updated_at" not in catalog.columns:
        return catalog
    now = F.current_timestamp() if now is None else now
    return catalog.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))


def _set_status(catalog: DataFrame, ids: DataFrame, status: str, now: Column | None) -> DataFrame:
    listed = ids.select("doc_id").distinct().withColumn("__listed", F.lit(True))
    marked = catalog.join(listed, "doc_id", "left").withColumn(
        "index_status", F.when(F.col("__listed"), F.lit(status)).otherwise(F.col("index_status"))
    )
    return _touched(marked, F.col("__listed"), now).drop("__listed")


def mark_reindex(catalog: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Listed documents become pending; tree and error message stay."""
    return _set_status(catalog, ids, PENDING, now)


def mark_indexing(catalog: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """First step of C13: listed documents become indexing."""
    return _set_status(catalog, ids, INDEXING, now)


def apply_status(catalog: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """Results (doc_id, success, page_count, error_message) → ready or error; unknown ids are ignored.

    Success sets the page count and keeps an old error message; failure keeps
    page count and tree.
    """
    found = results.select(
        "doc_id", F.col("success").alias("__ok"), F.col("page_count").alias("__pages"),
        F.col("error_message").alias("__error"),
    )
    ok, failed = F.col("__ok"), ~F.col("__ok")
    changed = catalog.join(found, "doc_id", "left").withColumns({
        "index_status": F.when(ok, READY).when(failed, ERROR).otherwise(F.col("index_status")),
        "page_count": F.when(ok, F.col("__pages")).otherwise(F.col("page_count")),
        "has_tree": F.when(ok, F.lit(True)).otherwise(F.col("has_tree")),
        "error_message": F.when(failed, F.col("__error")).otherwise(F.col("error_message")),
    })
    return _touched(changed, ok.isNotNull(), now).drop("__ok", "__pages", "__error")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """C11: ``tables`` without the listed documents and everything that hangs on them.

    ``catalog``, ``conversations`` and ``messages`` are needed; any other table is
    taken to be derived from documents and to have a doc_id. Up to ``SMALL_ROWS``
    counted ids are sent to the rows, which then stay where they are. (Tables that
    are stored by :mod:`foliotree.sources.versions` needn't be rewritten at all.)
    """
    gone, few = _counted(ids.select("doc_id").distinct())
    by_document = gone.withColumnRenamed("doc_id", "document_id")
    conversations = tables["conversations"]
    of_documents = _joined(conversations.select("conversation_id", "document_id"), by_document, few, "document_id", "conversation_id", "left_semi")
    gone_conversations, few_conversations = _counted(of_documents.select("conversation_id"))
    kept = {
        "catalog": _joined(tables["catalog"], gone, few, "doc_id", "doc_id", "left_anti"),
        "conversations": _joined(conversations, by_document, few, "document_id", "conversation_id", "left_anti"),
        "messages": _joined(tables["messages"], gone_conversations, few_conversations, "conversation_id", "message_id", "left_anti"),
    }
    for name, table in tables.items():
        if name not in kept:
            kept[name] = table.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    return kept


# Conversations

def conversation_title(message: Column, style: str = "batch") -> Column:
    """The start of the message; 'batch' adds dots to a cut title only, 'stream' always."""
    start = F.concat(F.substring(message, 1, TITLE_CHARS), F.lit(ELLIPSIS))
    return start if style == "stream" else F.when(F.length(message) > TITLE_CHARS, start).otherwise(message)


def _message_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "conversation_id", "message_id", "role", "content", "references", F.col("created_at").alias("message_at")
    )


def _listed(known: DataFrame, chosen: DataFrame, texts: DataFrame) -> DataFrame:
    silent = chosen.join(texts.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return known.unionByName(silent, allowMissingColumns=True).orderBy(
        F.desc("updated_at"), F.desc("conversation_id"), "message_at", "message_id"
    )


def list_conversations(conversations: DataFrame, messages: DataFrame, document_id=None) -> DataFrame:
    """Conversations newest first, each with its messages in time order.

    One row per message rather than one nested row per conversation: a
    conversation may be any share of all messages, and the global sort splits it
    like any other range of rows. Conversations without messages keep one row
    with null message columns. ``document_id`` keeps the conversations of one
    document, or of a DataFrame of documents (document_id).
    """
    chosen = conversations if document_id is None else _matching(conversations, "document_id", document_id)
    texts = _message_columns(messages)
    return _listed(join_hot(texts, chosen, "conversation_id", ["message_id"]), chosen, texts)


def get_conversation(conversations: DataFrame, messages: DataFrame, conversation_id) -> DataFrame:
    """One conversation with its messages; both tables are filtered before they meet.

    The conversation side is one row at most, since ids are unique, so it is
    broadcast and its messages stay where they are.
    """
    wanted = F.col("conversation_id") == F.lit(conversation_id)
    chosen, texts = conversations.where(wanted), _message_columns(messages.where(wanted))
    return _listed(texts.join(F.broadcast(chosen), "conversation_id"), chosen, texts)


def get_or_create(requests: DataFrame, conversations: DataFrame, style: str = "batch",
                  now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, created, rejected) of chat requests (question_id, conversation_id, document_id, message).

    A known conversation brings its own document; an unknown one is rejected; no
    conversation makes a new one with an id derived from the request. An empty id
    counts as none. A request that is run again does not create its conversation again.
    """
    now = F.current_timestamp() if now is None else now
    given = requests.withColumn("conversation_id", F.nullif(F.col("conversation_id").cast("string"), F.lit("")))
    named = given.where(F.col("conversation_id").isNotNull())
    known = conversations.select(
        F.col("conversation_id").cast("string").alias("conversation_id"), F.col("document_id").alias("__document"),
        F.lit(True).alias("__known"),
    )
    looked_up = join_hot(named, known, "conversation_id", ["question_id"], "left")
    continued = looked_up.where(F.col("__known")).withColumn("document_id", F.col("__document")).drop("__document", "__known")
    rejected = looked_up.where(F.col("__known").isNull()).select(
        "question_id", "conversation_id", F.lit("conversation not found").alias("reason")
    )
    opened = given.where(F.col("conversation_id").isNull()).withColumn(
        "conversation_id", F.sha2(F.concat_ws("|", F.lit("conversation"), F.col("question_id").cast("string")), 256)
    )
    created = opened.join(conversations.select(F.col("conversation_id").cast("string").alias("conversation_id")), "conversation_id", "left_anti").select(
        "conversation_id", conversation_title(F.col("message"), style).alias("title"), "document_id",
        now.alias("created_at"), now.alias("updated_at"),
    )
    return continued.unionByName(opened), created, rejected


def append_messages(messages: DataFrame, conversations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new messages; a conversation is as recent as its newest message.

    A message that is there already, by its id, is not stored again, and an older
    one does not move its conversation back: a job that runs again changes nothing.
    Of the old messages only the ids are read; a table that is stored by
    :mod:`foliotree.sources.versions` is opened only where a repeat may be.
    """
    fresh = new.join(messages.select("message_id"), "message_id", "left_anti")
    touched = new.groupBy("conversation_id").agg(F.max("created_at").alias("__at"))
    newer = conversations.join(touched, "conversation_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "__at")
    ).drop("__at")
    return messages.unionByName(fresh, allowMissingColumns=True), newer


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed conversations."""
    gone, few = _counted(ids.select("conversation_id").distinct())
    return (
        _joined(conversations, gone, few, "conversation_id", "conversation_id", "left_anti"),
        _joined(messages, gone, few, "conversation_id", "message_id", "left_anti"),
    )
