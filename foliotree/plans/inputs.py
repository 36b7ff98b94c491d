"""Tables of the data model derived from the given Parquet tables, for the registered queries.

The given data has documents and message turns but no files, conversations,
model responses or timestamps. Each is derived by a fixed rule, stated once as a
DataFrame and once as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliotree.functions.text import WHITESPACE
from foliotree.operators.catalog import conversation_title
from foliotree.operators.pagers import page_fixed
from foliotree.session import plain_unions
from foliotree.sources.tables import spread

EPOCH = 1_700_000_000


class Inputs:
    """Lazily derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        plain_unions(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text"), "doc_id")

    @property
    def files(self) -> DataFrame:
        """Scanned files: path, name, length, modified_at, content. One in five has a foreign type."""
        ext = F.element_at(F.array(*map(F.lit, [".txt", ".MD", ".pdf", ".docx", ".bin"])), (F.col("doc_id") % 5 + 1).cast("int"))
        name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext)
        return self.table("documents").select(
            "doc_id", F.concat(F.lit("uploads/"), name).alias("path"), name.alias("name"),
            F.octet_length("text").cast("long").alias("length"),
            F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("modified_at"), F.col("text").cast("binary").alias("content"),
        )

    @property
    def decoded(self) -> DataFrame:
        """Decoded documents: types .txt, .md, .pdf, .docx and .bin, with what each pager reads."""
        kind = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".pdf", ".docx", ".bin"])), (F.col("doc_id") % 5 + 1).cast("int"))
        return self.documents.select(
            "doc_id", kind.alias("file_type"), "text",
            F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 20)).alias("rich_text"),
            F.regexp_extract_all("text", F.lit("(?s).{1,2000}"), F.lit(0)).alias("raw_pages"),
            F.split("text", "\n", -1).alias("paragraphs"),
        )

    @property
    def pages(self) -> DataFrame:
        return page_fixed(self.documents)

    @property
    def catalog(self) -> DataFrame:
        last = F.col("doc_id") % 10
        status = F.when(last == 7, "error").when(last == 8, "pending").when(last == 9, "indexing").otherwise("ready")
        return self.table("documents").select(
            "doc_id",
            F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
            F.concat(F.lit("uploads/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
            F.lit(".txt").alias("file_type"),
            F.octet_length("text").cast("long").alias("file_size"),
            F.ceil(F.length("text") / 3000).cast("int").alias("page_count"),
            status.alias("index_status"),
            (status == "ready").alias("has_tree"),
            F.when(last == 7, F.lit("the file is not valid UTF-8")).alias("error_message"),
            F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("created_at"),
            F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("updated_at"),
        )

    @property
    def docs(self) -> DataFrame:
        """(doc_id, title, page_count) of all documents."""
        return self.catalog.select("doc_id", F.col("doc_id").cast("string").alias("title"), "page_count")

    @property
    def turns(self) -> DataFrame:
        conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
        return self.table("conversations").select(
            "conv_id", "turn", "role", "text",
            F.concat(F.lit("c"), conv).alias("conversation_id"),
            F.concat(F.lit("c"), conv, F.lit("-"), turn).alias("message_id"),
            F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn") + EPOCH).alias("created_at"),
        )

    @property
    def messages(self) -> DataFrame:
        """User and assistant turns; any other role is not a message of the model."""
        return self.turns.where(F.col("role").isin("user", "assistant")).select(
            "message_id", "conversation_id", "role", F.col("text").alias("content"),
            F.lit(None).cast("array<struct<page:int,reason:string,preview:string>>").alias("references"), "created_at",
        )

    @property
    def conversations(self) -> DataFrame:
        """One conversation in five has no document; the title comes from the first question."""
        asked = F.when(F.col("role") == "user", F.col("turn"))
        return self.turns.groupBy("conversation_id").agg(
            F.min("conv_id").alias("conv_id"),
            F.min_by(conversation_title(F.col("text")), asked).alias("title"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        ).select(
            "conversation_id", F.coalesce("title", F.lit("New Conversation")).alias("title"),
            F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")).alias("document_id"), "created_at", "updated_at",
        )

    @property
    def questions(self) -> DataFrame:
        return self.turns.where(F.col("role") == "user").select(
            F.col("message_id").alias("question_id"), "conversation_id", "conv_id", F.col("text").alias("message"),
        )

    @property
    def document_questions(self) -> DataFrame:
        """Questions of conversations that have a document."""
        return self.questions.where(F.col("conv_id") % 5 != 0).select(
            "question_id", F.col("conv_id").alias("doc_id"), "message"
        )

    @property
    def chunks(self) -> DataFrame:
        return chunk_events(self.turns).where(~F.col("done")).select("message_id", "seq", "chunk")


def chunk_events(turns: DataFrame) -> DataFrame:
    """Assistant texts as chunk events, a word each, with some think tags and blank chunks, and a last done event."""
    words = F.split("text", " ", -1)
    tagged = F.transform(words, lambda w, i: F.when(i % 17 == 5, F.concat(F.lit("<think>"), w)).when(
        i % 17 == 6, F.concat(w, F.lit("</think>"))).when(i % 13 == 7, F.lit("  ")).otherwise(F.concat(w, F.lit(" "))))
    events = F.concat(
        F.transform(tagged, lambda c, i: F.struct(i.alias("seq"), c.alias("chunk"), F.lit(False).alias("done"))),
        F.array(F.struct(F.size(tagged).alias("seq"), F.lit(None).cast("string").alias("chunk"), F.lit(True).alias("done"))),
    )
    return turns.where(F.col("role") == "assistant").select("message_id", "created_at", F.inline_outer(events)).select(
        "message_id", "seq", "chunk", "done", F.col("created_at").alias("ts")
    )


def summary_response() -> Column:
    """A model response per page (doc_id, page_number), of every kind of defect."""
    page, doc = F.col("page_number").cast("string"), F.col("doc_id").cast("string")
    kind = (F.col("doc_id") + F.col("page_number")) % 8
    return (
        F.when((F.col("doc_id") % 9 == 4) & (F.col("page_number") == 1), F.lit('{"summary": "s", "key_topics": [1]}'))
        .when(kind == 1, F.lit("no json here"))
        .when(kind == 2, F.concat(F.lit('Sure: {"summary": "About page '), page, F.lit(" of document "), doc,
                                  F.lit('", "key_topics": ["p'), page, F.lit('", "d'), doc, F.lit('"]} done')))
        .when(kind == 3, F.concat(F.lit('<think>{"a": 1}</think>{"summary": "thought '), page, F.lit('"}')))
        .when(kind == 4, F.lit('{"summary": "a"} {"summary": "b"}'))
        .when(kind == 5, F.lit("{}"))
        .when(kind == 6, F.lit('{"summary": null, "key_topics": null}'))
        .when(kind == 7, F.concat(F.lit('{"summary": "no topics '), page, F.lit('", "key_topics": []}')))
    )


def toc_response() -> Column:
    """A model response per document (doc_id)."""
    doc, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    return (
        F.when(kind == 0, F.lit('{"sections": [{"title": "A"}]}'))
        .when(kind == 1, F.lit('{"sections": [{"title": "A", "page_start": 2, "page_end": 4, "subsections": '
                               '[{"title": "A1"}, {"title": "A2", "page_start": 3, "level": 3}]}, {"title": "B"}]}'))
        .when(kind == 2, F.lit('{"sections": [{"title": "A", "subsections": [{"title": "A1", "page_start": 1, "page_end": 2}]}]}'))
        .when(kind == 3, F.lit('{"sections": [{"page_start": 1}]}'))
        .when(kind == 4, F.lit("there are no sections"))
        .when(kind == 5, F.lit('<think>{</think>{"sections": []}'))
        .when(kind == 7, F.concat(F.lit('{"sections": [{"title": "Part '), doc, F.lit('", "page_start": 1, "page_end": null}, {"title": "Rest", "page_start": '),
                                  (F.col("doc_id") % 3 + 1).cast("string"), F.lit("}]}")))
    )


def range_response(size: Column) -> Column:
    """A model response per question, by the length of its message."""
    kind, first = size % 9, (size % 4 + 1).cast("string")
    return (
        F.when(kind == 0, F.concat(F.lit('[{"page_start": '), first, F.lit(', "page_end": 3, "reason": "r"}, {"page_start": 1, "page_end": 2}]')))
        .when(kind == 1, F.lit("Sure: [{}] done"))
        .when(kind == 2, F.lit("[]"))
        .when(kind == 3, F.concat(F.lit('[{"page_start": '), first, F.lit("}, 3]")))
        .when(kind == 4, F.lit("[1] x [2]"))
        .when(kind == 5, F.concat(F.lit('<think>[9]</think>[{"page_start": 2, "page_end": 1}, {"page_start": '), first, F.lit(', "page_end": 900}]')))
        .when(kind == 6, F.lit('[{"page_start": "3"}]'))
        .when(kind == 7, F.lit('[{"page_start": 1}, {"page_start": 2}, {"page_start": 3}, {"page_start": 1}, {"page_start": 2}, {"page_start": 3}, 7]'))
    )


# The same derivations in SQL.

_KINDS = "list_extract(['.txt', '{md}', '.pdf', '.docx', '.bin'], CAST(doc_id % 5 + 1 AS BIGINT))"

BLANKS = "'" + WHITESPACE + "'"

CTES: dict[str, str] = {
    "files": f"""SELECT doc_id, 'uploads/' || source || '_' || doc_id || {_KINDS.format(md='.MD')} AS path,
        source || '_' || doc_id || {_KINDS.format(md='.MD')} AS name, CAST(strlen(text) AS BIGINT) AS length,
        doc_id + {EPOCH} AS modified_s FROM documents""",
    "decoded": f"""SELECT doc_id, {_KINDS.format(md='.md')} AS file_type, text,
        CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, 20) END AS rich_text FROM documents""",
    "doc_pages": """SELECT doc_id, CAST(i AS INTEGER) AS page_number, substr(text, (i - 1) * 3000 + 1, 3000) AS content,
        CAST(length(substr(text, (i - 1) * 3000 + 1, 3000)) AS INTEGER) AS char_count
        FROM documents, unnest(range(1, CAST(ceil(length(text) / 3000) AS BIGINT) + 1)) AS r(i)""",
    "catalog": f"""SELECT doc_id, source || '_' || doc_id || '.txt' AS name, 'uploads/' || doc_id || '.txt' AS file_path,
        '.txt' AS file_type, CAST(strlen(text) AS BIGINT) AS file_size, CAST(ceil(length(text) / 3000) AS INTEGER) AS page_count,
        CASE doc_id % 10 WHEN 7 THEN 'error' WHEN 8 THEN 'pending' WHEN 9 THEN 'indexing' ELSE 'ready' END AS index_status,
        doc_id % 10 NOT IN (7, 8, 9) AS has_tree,
        CASE WHEN doc_id % 10 = 7 THEN 'the file is not valid UTF-8' END AS error_message,
        doc_id + {EPOCH} AS created_s, doc_id + {EPOCH} AS updated_s FROM documents""",
    "turns": f"""SELECT conv_id, turn, role, text, 'c' || conv_id AS conversation_id, 'c' || conv_id || '-' || turn AS message_id,
        conv_id * 100 + turn + {EPOCH} AS created_s FROM main.conversations""",
    "messages": """SELECT message_id, conversation_id, role, text AS content, created_s FROM turns
        WHERE role IN ('user', 'assistant')""",
    "convs": """SELECT conversation_id, coalesce(arg_min(CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END, turn)
        FILTER (WHERE role = 'user'), 'New Conversation') AS title,
        CASE WHEN min(conv_id) % 5 <> 0 THEN min(conv_id) END AS document_id, min(created_s) AS created_s, max(created_s) AS updated_s
        FROM turns GROUP BY conversation_id""",
    "questions": """SELECT message_id AS question_id, conversation_id, conv_id, text AS message FROM turns WHERE role = 'user'""",
    "document_questions": "SELECT question_id, conv_id AS doc_id, message FROM questions WHERE conv_id % 5 <> 0",
    "words": """SELECT message_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS seq, unnest(ws) AS w
        FROM (SELECT message_id, string_split(text, ' ') AS ws FROM turns WHERE role = 'assistant')""",
    "chunks": """SELECT message_id, seq, CASE WHEN seq % 17 = 5 THEN '<think>' || w WHEN seq % 17 = 6 THEN w || '</think>'
        WHEN seq % 13 = 7 THEN '  ' ELSE w || ' ' END AS chunk FROM words""",
    "summary_responses": """SELECT doc_id, page_number, content, CASE
        WHEN doc_id % 9 = 4 AND page_number = 1 THEN '{"summary": "s", "key_topics": [1]}'
        ELSE CASE (doc_id + page_number) % 8 WHEN 1 THEN 'no json here'
        WHEN 2 THEN 'Sure: {"summary": "About page ' || page_number || ' of document ' || doc_id || '", "key_topics": ["p' || page_number || '", "d' || doc_id || '"]} done'
        WHEN 3 THEN '<think>{"a": 1}</think>{"summary": "thought ' || page_number || '"}'
        WHEN 4 THEN '{"summary": "a"} {"summary": "b"}' WHEN 5 THEN '{}'
        WHEN 6 THEN '{"summary": null, "key_topics": null}'
        WHEN 7 THEN '{"summary": "no topics ' || page_number || '", "key_topics": []}' END END AS response FROM doc_pages""",
    "summary_spans": r"""SELECT *, nullif(regexp_extract(trim(regexp_replace(response, '<think>.*?</think>', '', 'gs'), """ + BLANKS + r"""),
        '\{.*\}', 0, 's'), '') AS span FROM summary_responses""",
    "model_summaries": """SELECT doc_id, page_number,
        CASE WHEN length(trim(content, """ + BLANKS + """)) < 50 THEN ''
             WHEN span IS NULL OR NOT json_valid(span) THEN left(content, 200) || '...'
             WHEN json_exists(span, '$.summary') THEN json_extract_string(span, '$.summary') ELSE '' END AS summary,
        CASE WHEN length(trim(content, """ + BLANKS + """)) < 50 OR span IS NULL OR NOT json_valid(span) OR NOT json_exists(span, '$.key_topics')
             THEN CAST([] AS VARCHAR[])
             WHEN json_type(span, '$.key_topics') = 'ARRAY' AND coalesce(list_bool_and(list_transform(
                  CAST(json_extract(span, '$.key_topics') AS JSON[]), lambda t: json_type(t) = 'VARCHAR')), true)
             THEN list_transform(CAST(json_extract(span, '$.key_topics') AS JSON[]), lambda t: t ->> '$') END AS key_topics
        FROM summary_spans""",
    "toc_responses": """SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, page_count, CASE doc_id % 8
        WHEN 0 THEN '{"sections": [{"title": "A"}]}'
        WHEN 1 THEN '{"sections": [{"title": "A", "page_start": 2, "page_end": 4, "subsections": [{"title": "A1"}, {"title": "A2", "page_start": 3, "level": 3}]}, {"title": "B"}]}'
        WHEN 2 THEN '{"sections": [{"title": "A", "subsections": [{"title": "A1", "page_start": 1, "page_end": 2}]}]}'
        WHEN 3 THEN '{"sections": [{"page_start": 1}]}' WHEN 4 THEN 'there are no sections'
        WHEN 5 THEN '<think>{</think>{"sections": []}'
        WHEN 7 THEN '{"sections": [{"title": "Part ' || doc_id || '", "page_start": 1, "page_end": null}, {"title": "Rest", "page_start": ' || (doc_id % 3 + 1) || '}]}'
        END AS response FROM catalog""",
    "toc_spans": r"""SELECT *, nullif(regexp_extract(trim(regexp_replace(response, '<think>.*?</think>', '', 'gs'), """ + BLANKS + r"""),
        '\{.*\}', 0, 's'), '') AS span FROM toc_responses""",
    "toc_items": """SELECT doc_id, title, page_count, CAST(json_extract(span, '$.sections') AS JSON[]) AS sections
        FROM toc_spans WHERE span IS NOT NULL AND json_valid(span)""",
    "toc_docs": """SELECT doc_id, title, page_count, sections FROM toc_items
        WHERE coalesce(list_bool_and(list_transform(sections, lambda s: json_exists(s, '$.title') AND (
            coalesce(json_array_length(s, '$.subsections'), 0) = 0 OR (json_exists(s, '$.page_start') AND json_exists(s, '$.page_end')
            AND list_bool_and(list_transform(CAST(json_extract(s, '$.subsections') AS JSON[]), lambda t: json_exists(t, '$.title'))))))), true)""",
    "toc_sections": """SELECT doc_id, CAST([i] AS INTEGER[]) AS path, s, coalesce(CAST(s ->> '$.level' AS INTEGER), 1) AS level, s ->> '$.title' AS title,
        CASE WHEN json_exists(s, '$.page_start') THEN CAST(s ->> '$.page_start' AS INTEGER) ELSE 1 END AS page_start,
        CASE WHEN json_exists(s, '$.page_end') THEN CAST(s ->> '$.page_end' AS INTEGER) ELSE page_count END AS page_end
        FROM (SELECT doc_id, page_count, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM toc_docs)""",
    "toc_subsections": """SELECT doc_id, list_append(path, CAST(j AS INTEGER)) AS path, coalesce(CAST(t ->> '$.level' AS INTEGER), 2) AS level,
        t ->> '$.title' AS title,
        CASE WHEN json_exists(t, '$.page_start') THEN CAST(t ->> '$.page_start' AS INTEGER) ELSE page_start END AS page_start,
        CASE WHEN json_exists(t, '$.page_end') THEN CAST(t ->> '$.page_end' AS INTEGER) ELSE page_end END AS page_end
        FROM (SELECT doc_id, path, page_start, page_end, unnest(subs) AS t, generate_subscripts(subs, 1) AS j
              FROM (SELECT *, CAST(json_extract(s, '$.subsections') AS JSON[]) AS subs FROM toc_sections))""",
    "sources": """SELECT doc_id, title, page_count, CASE WHEN NOT EXISTS (SELECT 1 FROM doc_pages p WHERE p.doc_id = t.doc_id
            AND length(trim(p.content, """ + BLANKS + """)) >= 50) THEN 'none'
        WHEN doc_id IN (SELECT doc_id FROM toc_docs) THEN 'toc' ELSE 'error' END AS tree_source FROM toc_responses t""",
    "model_nodes": """
        SELECT doc_id, CAST([] AS INTEGER[]) AS path, 0 AS level, title, 1 AS page_start, page_count AS page_end, '' AS raw_content, tree_source FROM sources
        UNION ALL SELECT doc_id, CAST([page_number] AS INTEGER[]), 1, 'Page ' || page_number, page_number, page_number,
            left(content, CASE tree_source WHEN 'none' THEN 500 ELSE 1000 END), tree_source
            FROM doc_pages JOIN sources USING (doc_id) WHERE tree_source <> 'toc'
        UNION ALL SELECT doc_id, path, level, s.title, page_start, page_end, '', 'toc' FROM toc_sections s JOIN sources USING (doc_id) WHERE tree_source = 'toc'
        UNION ALL SELECT doc_id, path, level, s.title, page_start, page_end, '', 'toc' FROM toc_subsections s JOIN sources USING (doc_id) WHERE tree_source = 'toc'""",
    "plain_sources": """SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, page_count, CASE WHEN doc_id IN (SELECT doc_id FROM doc_pages
            WHERE length(trim(content, """ + BLANKS + """)) >= 50) THEN 'error' ELSE 'none' END AS tree_source FROM catalog""",
    "nodes": """
        SELECT doc_id, CAST([] AS INTEGER[]) AS path, 0 AS level, title, 1 AS page_start, page_count AS page_end, '' AS raw_content FROM plain_sources
        UNION ALL SELECT doc_id, CAST([page_number] AS INTEGER[]), 1, 'Page ' || page_number, page_number, page_number,
            left(content, CASE tree_source WHEN 'none' THEN 500 ELSE 1000 END) FROM doc_pages JOIN plain_sources USING (doc_id)""",
    "range_responses": """SELECT question_id, doc_id, page_count, CASE length(message) % 9
        WHEN 0 THEN '[{"page_start": ' || (length(message) % 4 + 1) || ', "page_end": 3, "reason": "r"}, {"page_start": 1, "page_end": 2}]'
        WHEN 1 THEN 'Sure: [{}] done' WHEN 2 THEN '[]' WHEN 3 THEN '[{"page_start": ' || (length(message) % 4 + 1) || '}, 3]'
        WHEN 4 THEN '[1] x [2]'
        WHEN 5 THEN '<think>[9]</think>[{"page_start": 2, "page_end": 1}, {"page_start": ' || (length(message) % 4 + 1) || ', "page_end": 900}]'
        WHEN 6 THEN '[{"page_start": "3"}]'
        WHEN 7 THEN '[{"page_start": 1}, {"page_start": 2}, {"page_start": 3}, {"page_start": 1}, {"page_start": 2}, {"page_start": 3}, 7]'
        END AS response FROM document_questions JOIN catalog USING (doc_id) WHERE has_tree""",
    "range_spans": r"""SELECT *, nullif(regexp_extract(trim(regexp_replace(response, '<think>.*?</think>', '', 'gs'), """ + BLANKS + r"""),
        '\[.*\]', 0, 's'), '') AS span FROM range_responses""",
    "range_items": """SELECT question_id, doc_id, page_count,
        CASE WHEN span IS NOT NULL AND json_valid(span) THEN CAST(span AS JSON[])[1:5] END AS items FROM range_spans""",
    "range_choice": """SELECT *, items IS NOT NULL AND coalesce(list_bool_and(list_transform(items, lambda r: json_type(r) = 'OBJECT'
        AND coalesce(json_type(r, '$.page_start'), 'UBIGINT') IN ('UBIGINT', 'BIGINT')
        AND coalesce(json_type(r, '$.page_end'), 'UBIGINT') IN ('UBIGINT', 'BIGINT'))), true) AS usable FROM range_items""",
    "ranges": """SELECT question_id, doc_id, CAST(i AS INTEGER) AS rank, coalesce(CAST(r ->> '$.page_start' AS BIGINT), 1) AS page_start,
        coalesce(CAST(r ->> '$.page_end' AS BIGINT), CAST(r ->> '$.page_start' AS BIGINT), 1) AS page_end, coalesce(r ->> '$.reason', '') AS reason
        FROM (SELECT question_id, doc_id, unnest(items) AS r, generate_subscripts(items, 1) AS i FROM range_choice WHERE usable)""",
    "retrieved_ranges": """SELECT question_id, doc_id, rank, page_number AS page, content, reason, char_count
        FROM ranges JOIN doc_pages USING (doc_id) WHERE page_number BETWEEN page_start AND page_end""",
    "retrieved_model": """SELECT * FROM retrieved_ranges UNION ALL
        SELECT question_id, doc_id, page_number, page_number, content, 'Content page', char_count
        FROM range_choice JOIN doc_pages USING (doc_id) WHERE NOT usable AND page_number <= 5""",
    "retrieved": """SELECT question_id, doc_id, page_number AS rank, page_number AS page, content, 'Content page' AS reason, char_count
        FROM document_questions JOIN catalog USING (doc_id) JOIN doc_pages USING (doc_id) WHERE has_tree AND page_number <= 5""",
}

_NEEDS = {
    "messages": ["turns"], "convs": ["turns"], "questions": ["turns"], "document_questions": ["questions"],
    "words": ["turns"], "chunks": ["words"],
    "summary_responses": ["doc_pages"], "summary_spans": ["summary_responses"], "model_summaries": ["summary_spans"],
    "toc_responses": ["catalog"], "toc_spans": ["toc_responses"], "toc_items": ["toc_spans"], "toc_docs": ["toc_items"],
    "toc_sections": ["toc_docs"], "toc_subsections": ["toc_sections"], "sources": ["toc_docs", "doc_pages"],
    "model_nodes": ["sources", "toc_subsections", "doc_pages"],
    "plain_sources": ["catalog", "doc_pages"], "nodes": ["plain_sources"],
    "range_responses": ["document_questions", "catalog"], "range_spans": ["range_responses"], "range_items": ["range_spans"],
    "range_choice": ["range_items"], "ranges": ["range_choice"], "retrieved_ranges": ["ranges", "doc_pages"],
    "retrieved_model": ["retrieved_ranges"], "retrieved": ["document_questions", "catalog", "doc_pages"],
}


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the named derived tables and those they are derived from."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body
