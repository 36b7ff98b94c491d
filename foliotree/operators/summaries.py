"""Page summaries and their roll-up per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.completer import Completer, asks
from foliotree.functions.text import (
    json_object_span, strip, strip_think, truncate, variant_kind, variant_text, with_strict_json,
)

# Lengths in characters, and the mark put after a cut summary.
MIN_PAGE_CHARS = 50
PROMPT_CHARS = 4000
FALLBACK_CHARS = 200
ELLIPSIS = "..."

# The line of a page in the roll-up, around its number, summary and topics, and what separates topics and lines.
PAGE_LINE = ("Page ", ": ", " (Topics: ", ")")
TOPIC_SEPARATOR = ", "
LINE_SEPARATOR = "\n"

SYSTEM = "You analyse documents. Reply with one JSON value and nothing else."

PAGE_PROMPT = (
    "Summarise the page below in two or three sentences and name its main topics. "
    "Mention tables and classifications if there are any.\n"
    'Reply as {"summary": text, "key_topics": [text, ...], "has_tables": boolean, "tables_description": text}.\n\n'
    "Page:\n"
)

TOPICS_ERROR = "key topics of a summarised page are not a list of strings"


def split_eligible(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS, n: int = FALLBACK_CHARS) -> DataFrame:
    """M1, M2: ``excerpt`` = the start of pages worth summarising, null for the others.

    ``opening`` is the part of it that the fallback shows: with it at hand, the
    excerpt need not travel through the join with the responses.
    """
    eligible = F.length(strip(F.col("content"))) >= min_chars
    excerpt = F.when(eligible, truncate(F.col("content"), PROMPT_CHARS))
    return pages.withColumn("excerpt", excerpt).withColumn("opening", truncate(excerpt, n))


def summary_requests(pages: DataFrame) -> DataFrame:
    """M3: add system and prompt; the prompt is null where no summary is asked for."""
    return pages.withColumn("system", F.lit(SYSTEM)).withColumn("prompt", F.concat(F.lit(PAGE_PROMPT), "excerpt"))


def _truthy(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _summary(v: Column) -> Column:
    """Summary text: false, 0 and empty containers count as empty like null does."""
    kind, text = variant_kind(v), variant_text(v)
    return (
        F.when(v.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")).otherwise(F.lit("")))
        .when(kind == "STRING", text)
        .when(text.isin("0", "[]", "{}"), F.lit(""))
        .otherwise(text)
    )


def _topics(v: Column) -> Column:
    """Topics: a list as it is; a string is a list of its characters; null if not iterable as text."""
    items = v.try_cast("array<variant>")
    all_text = F.forall(items, lambda t: F.coalesce(variant_kind(t), F.lit("VOID")) == "STRING")
    kind = variant_kind(v)
    none = F.array().cast("array<string>")
    return (
        F.when(v.isNull(), none)
        .when(kind == "ARRAY", F.when(all_text, F.transform(items, variant_text)))
        .when(kind == "STRING", F.filter(F.split(variant_text(v), ""), lambda c: c != ""))
        .when(kind == "OBJECT", F.map_keys(v.try_cast("map<string,variant>")))
    )


def decode_summary(responses: DataFrame) -> DataFrame:
    """M5-M7: add ``decoded`` (boolean), ``summary`` and ``key_topics`` from ``response``.

    ``key_topics`` is null where the model gave something that is no list of
    strings: harmless beside an empty summary, otherwise an error of the document.
    """
    parsed = with_strict_json(responses, json_object_span(strip_think(F.col("response"))), "__data")
    fields = parsed.withColumns({
        "decoded": F.col("__data").isNotNull(),
        "__s": F.try_variant_get("__data", "$.summary", "variant"),
        "__t": F.try_variant_get("__data", "$.key_topics", "variant"),
    })
    return fields.withColumns({
        "summary": F.when(F.col("decoded"), _summary(F.col("__s"))),
        "key_topics": F.when(F.col("decoded"), _topics(F.col("__t"))),
    }).drop("__data", "__s", "__t")


def with_summary_fallback(df: DataFrame) -> DataFrame:
    """M8: where nothing was decoded, the opening, always followed by dots; '' if ineligible.

    Rows without ``decoded`` were never asked about.
    """
    none = F.array().cast("array<string>")
    asked = F.col("opening").isNotNull()
    fallback = F.when(~asked, F.lit("")).otherwise(F.concat("opening", F.lit(ELLIPSIS)))
    if "decoded" not in df.columns:
        return df.withColumns({"summary": fallback, "key_topics": none})
    used = asked & F.coalesce("decoded", F.lit(False))
    return df.withColumns({
        "summary": F.when(used, F.col("summary")).otherwise(fallback),
        "key_topics": F.when(used, F.col("key_topics")).otherwise(none),
    })


def page_summaries(pages: DataFrame, completer: Completer | None = None) -> DataFrame:
    """M1-M8: (doc_id, page_number, summary, key_topics), one row per page, no shuffle by itself."""
    eligible = split_eligible(pages.select("doc_id", "page_number", "content"))
    if asks(completer):
        answered = completer.attach(summary_requests(eligible).drop("content", "excerpt"))
        decided = with_summary_fallback(decode_summary(answered))
    else:
        decided = with_summary_fallback(eligible)
    return decided.select("doc_id", "page_number", "summary", "key_topics")


def rollup_summaries(summaries: DataFrame) -> DataFrame:
    """M9: per document the lines 'Page n: summary (Topics: a, b)' in page order.

    Also ``has_summary`` and ``failed`` (topics unusable beside a summary), which
    are plain flags, so that a plan that never sends the roll-up to a model drops
    the concatenation altogether.
    """
    used = _truthy(F.col("summary"))
    before, after, topics, end = map(F.lit, PAGE_LINE)
    line = F.when(used, F.concat(
        before, F.col("page_number").cast("string"), after, F.col("summary"),
        topics, F.array_join("key_topics", TOPIC_SEPARATOR), end,
    ))
    return (
        summaries.select("doc_id", "page_number", used.alias("__used"), line.alias("__line"),
                         (used & F.col("key_topics").isNull()).alias("__bad"))
        .groupBy("doc_id")
        .agg(
            F.coalesce(
                F.expr(f"listagg(__line, '{LINE_SEPARATOR}') WITHIN GROUP (ORDER BY page_number)"), F.lit("")
            ).alias("rollup"),
            F.bool_or("__used").alias("has_summary"),
            F.bool_or("__bad").alias("failed"),
        )
    )
