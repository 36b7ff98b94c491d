"""Schemas of the tables the operators pass around.

Operators never look at the type of an id, so ``doc_id`` may be a long as well
as a string; the schemas below are the defaults used where this package
creates the rows itself.
"""

from __future__ import annotations

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_type", T.StringType(), False),
    T.StructField("file_size", T.LongType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("index_status", T.StringType()),
    T.StructField("has_tree", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

DOC_PAGES = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("char_count", T.IntegerType()),
])

NODES = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("node_id", T.StringType(), False),
    T.StructField("parent_id", T.StringType()),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("path", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("level", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("page_start", T.IntegerType()),
    T.StructField("page_end", T.IntegerType()),
    T.StructField("content_summary", T.StringType()),
    T.StructField("raw_content", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conversation_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

REFERENCES = T.ArrayType(T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("preview", T.StringType()),
]))

MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("conversation_id", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("references", REFERENCES),
    T.StructField("created_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("chunk", T.StringType()),
    T.StructField("done", T.BooleanType()),
    T.StructField("ts", T.TimestampType()),
])
