"""Text expressions: stripping, file names, think blocks, JSON spans.

All are built-in Spark expressions, so they stay on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What Python's str.strip() removes; all such characters lie below U+3001.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Pattern of a reasoning block, and the greedy JSON spans.
THINK_BLOCK = r"(?s)<think>.*?</think>"
OBJECT_SPAN = r"(?s)\{.*\}"
ARRAY_SPAN = r"(?s)\[.*\]"


def strip(col: Column) -> Column:
    """Python's ``strip()``: ``trim`` alone removes blanks only."""
    return F.btrim(col, F.lit(WHITESPACE))


def truncate(col: Column, n: int = 4000) -> Column:
    """M2: the first ``n`` code points."""
    return F.substring(col, 1, n)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_ext(name: Column) -> Column:
    """Lower-cased last suffix; '' for hidden and suffix-less names."""
    return F.lower(F.regexp_extract(name, r"^(?:.*/)?[^/]*[^/.][^/]*(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.*[^.].*)\.[^.]+$", "$1")


def doc_title(path: Column) -> Column:
    """Stem of the path, 'Untitled' when there is none."""
    return F.coalesce(stem(path), F.lit("Untitled"))


def strip_think(col: Column) -> Column:
    """M5: drop reasoning blocks, then strip."""
    return strip(F.regexp_replace(col, THINK_BLOCK, ""))


def json_object_span(col: Column) -> Column:
    """M6: from the first '{' to the last '}', null without a match."""
    return F.nullif(F.regexp_extract(col, OBJECT_SPAN, 0), F.lit(""))


def json_array_span(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, ARRAY_SPAN, 0), F.lit(""))


def with_strict_json(df: DataFrame, span: Column, out: str) -> DataFrame:
    """Add ``out``: the span as a Variant, null unless the *whole* span is one JSON value.

    Spark's JSON parser accepts text after the first value. The span is put in an
    array before its own digest; only a span that is exactly one value leaves an
    array of two whose last element is that digest. Of a key that occurs twice
    the last value counts.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text, pair = f"__{out}_text", f"__{out}_pair"
    mark = F.md5(F.col(text))
    wrapped = F.concat(F.lit("["), F.col(text), F.lit(',"'), mark, F.lit('"]'))
    kept = (F.size(pair) == 2) & (F.try_variant_get(F.get(F.col(pair), F.lit(1)), "$", "string") == mark)
    return (
        df.withColumn(text, span)
        .withColumn(pair, F.try_parse_json(wrapped).try_cast("array<variant>"))
        .withColumn(out, F.when(kept, F.get(F.col(pair), F.lit(0))))
        .drop(text, pair)
    )


def variant_kind(v: Column) -> Column:
    """Top-level type name: OBJECT, ARRAY, STRING, BIGINT, VOID, …; null if missing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def variant_text(v: Column) -> Column:
    """A JSON value as text; null for a missing value and for an explicit null."""
    return F.try_variant_get(v, "$", "string")


def variant_int(v: Column) -> Column:
    """An integral JSON number, or a string or decimal that is exactly an integer; else null."""
    return variant_text(v).try_cast("int")
