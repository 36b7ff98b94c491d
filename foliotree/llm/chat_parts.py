"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. The visitor
(one expression per part type) flattens the parts in order: text is escaped,
each attachment becomes a numbered placeholder, its reference is recorded and
its placeholder counts as many tokens as its type expands to. A conversation is
then one string of turns with a mask of the assistant's text. All of it is
built-in expressions.

In an escaped text the characters that start a control string do not occur: the
backslash is written ``\\b``, ``<`` is ``\\l`` and ``[`` is ``\\s``. Any other
``<`` or ``[`` belongs to the template, so a text that says ``[/INST]`` or
``</s>`` comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"
PART_TYPES = ("image", "audio", "document")
#: Tokens that a unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    out = text
    for raw, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """The text before :func:`escape`: every backslash starts one of three codes, and its own code is read last."""
    out = text
    for raw, code in (("<", "\\l"), ("[", "\\s"), ("\\", "\\b")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def text_part(text: Column) -> Column:
    """One text part; null is empty."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
                            null.cast("bigint").alias("units")))


def _units(part: Column) -> Column:
    return F.greatest(F.coalesce(part["units"], F.lit(1).cast("bigint")), F.lit(0).cast("bigint"))


def flatten(parts: Column) -> Column:
    """Visit the parts: ``(body, refs, tokens, unknown)``.

    ``body`` is the escaped text with placeholders ``<image 1>`` in place of
    attachments, numbered over all types in order; ``refs`` has number, type and
    reference (null stays null); ``tokens`` are those that the placeholders expand to. A null
    list or part is nothing. A part of another type is shown by its text, if
    any, and counted in ``unknown``.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    start = F.struct(
        F.array().cast("array<string>").alias("body"),
        F.array().cast("array<struct<number:int,type:string,ref:string,tokens:bigint>>").alias("refs"),
        F.lit(0).cast("bigint").alias("unknown"),
    )

    def visit(done: Column, part: Column) -> Column:
        kind = part["type"]
        number = F.size(done["refs"]) + 1
        attached = F.coalesce(kind.isin(*PART_TYPES), F.lit(False))
        tokens = _units(part) * F.element_at(F.create_map(*[F.lit(x) for k, v in TOKENS.items() for x in (k, v)]), kind).cast("bigint")
        ref = F.struct(number.alias("number"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))
        shown = F.when(attached, F.format_string("<%s %d>", kind, number)).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        return F.struct(
            F.concat(done["body"], F.array(shown)).alias("body"),
            F.when(attached, F.concat(done["refs"], F.array(ref))).otherwise(done["refs"]).alias("refs"),
            (done["unknown"] + (~attached & ~F.coalesce(kind == "text", F.lit(False))).cast("bigint")).alias("unknown"),
        )

    def finish(done: Column) -> Column:
        total = F.aggregate(done["refs"], F.lit(0).cast("bigint"), lambda s, r: s + r["tokens"])
        return F.struct(F.array_join(done["body"], "").alias("body"), done["refs"].alias("refs"), total.alias("tokens"),
                        done["unknown"].alias("unknown"))

    return F.aggregate(parts, start, visit, finish)


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         parts_col: str = "parts") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask, refs, attachment_tokens, unknown``.

    A turn is ``<|role|>`` and its body and ``</s>``; roles are escaped like text
    and ``|`` as well, a null role is empty. ``mask`` has the place (from 1) and
    start and end (code points from 0, end exclusive) of the body of every
    assistant turn; an empty body is an empty range. ``refs`` has turn place, number, type, reference and tokens of all attachments. Rows of equal turn
    are ordered by role, then body; a null turn comes first, repeated rows stay;
    rows with a null conversation are one conversation. Other columns of
    ``messages`` are not read.

    A conversation is gathered in one row because its formatted string is one
    value; that string bounds what a task holds.
    """
    flat = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        flatten(F.col(parts_col)).alias("flat"),
    )
    turns = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "flat.body", "flat.refs", "flat.tokens", "flat.unknown")
    )).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>")))
    turns = turns.withColumn("heads", head)
    pieces = F.transform("turns", lambda t, i: F.concat(F.element_at("heads", i + 1), t["body"], F.lit("</s>")))
    turns = turns.withColumn("pieces", pieces)
    before = F.aggregate(
        "pieces", F.array(F.lit(0).cast("bigint")),
        lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.length(p))),
    )
    turns = turns.withColumn("before", before)

    def masked(t: Column, i: Column) -> Column:
        start = F.element_at("before", i + 1) + F.length(F.element_at("heads", i + 1))
        return F.struct(t["role"].alias("role"), (i + 1).alias("place"), start.alias("start"), (start + F.length(t["body"])).alias("end"))

    mask = F.filter(F.transform("turns", masked), lambda m: m["role"] == "assistant")
    refs = F.flatten(F.transform("turns", lambda t, i: F.transform(t["refs"], lambda r: F.struct(
        (i + 1).alias("place"), r["number"].alias("number"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    add = lambda field: F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t[field])
    return turns.select(
        "conv_id", F.array_join("pieces", "").alias("formatted"),
        F.transform(mask, lambda m: F.struct(m["place"].alias("place"), m["start"].alias("start"), m["end"].alias("end"))).alias("mask"),
        refs.alias("refs"), add("tokens").alias("attachment_tokens"), add("unknown").alias("unknown"),
    )


def parse(formatted: Column) -> Column:
    """Read a formatted conversation back: ``array<struct<role,text>>``; placeholders stay in the text of their turn.

    ``</s>`` and ``<|`` occur only where the template wrote them.
    """
    pieces = F.split(formatted, "</s>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "|>")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(3), at - 3)).alias("role"), unescape(F.substring(piece, at + 2, F.length(piece))).alias("text")
        )

    return F.transform(turns, turn)


def with_loss_texts(formatted: DataFrame, out: str = "loss_texts") -> DataFrame:
    """Add the assistant's texts, cut out of the formatted string by the mask and unescaped.

    A range is cut out of its own turn, so that the work is in proportion to the string.
    """
    split = formatted.withColumn("__pieces", F.split("formatted", "</s>"))
    before = F.aggregate(
        "__pieces", F.array(F.lit(0).cast("bigint")),
        lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.length(p) + 4)),
    )

    def text(m: Column) -> Column:
        start = m["start"] - F.element_at("__before", m["place"]) + 1
        return unescape(F.substring(F.element_at("__pieces", m["place"]), start.cast("int"), (m["end"] - m["start"]).cast("int")))

    return split.withColumn("__before", before).withColumn(out, F.transform("mask", text)).drop("__pieces", "__before")
