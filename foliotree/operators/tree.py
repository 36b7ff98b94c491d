"""The table-of-contents tree of a document, as one row per node.

A node is addressed by its document and its ``path``: [] is the root, [3] its
third child, [3, 1] a child of that. Sorting by path is the pre-order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec, functions as F

from foliotree.completer import Completer, asks
from foliotree.functions.durable import cut, stored
from foliotree.functions.text import (
    json_object_span, strip_think, truncate, variant_int, variant_kind, variant_text, with_strict_json,
)
from foliotree.operators.summaries import SYSTEM, TOPICS_ERROR, rollup_summaries

# Characters of page text kept in a fallback leaf, without any summary and after an error.
RAW_CHARS_NO_SUMMARY = 500
RAW_CHARS_ERROR = 1000
MAX_HEADING_LEVEL = 3

# Title of a fallback leaf, a line of the tree text around level, title and pages, and its indent.
LEAF_TITLE = "Page "
TREE_LINE = ("[L", "] ", " (pages ", "-", ")\n")
INDENT = "  "
NO_VALUE = "None"

TOC_PROMPT = (
    "Arrange the document into main sections (level 1) with optional subsections (level 2), each with its title "
    "and its first and last page, judging by the page summaries.\n"
    'Reply as {"sections": [{"title": text, "level": 1, "page_start": number, "page_end": number, '
    '"subsections": [{"title": text, "level": 2, "page_start": number, "page_end": number}]}]}.\n\n'
)

NODE_COLUMNS = (
    "doc_id", "node_id", "parent_id", "ord", "depth", "path", "level", "title", "page_start", "page_end",
    "content_summary", "raw_content",
)
PATH = "array<int>"


def node_id(doc_id: Column, path: Column) -> Column:
    """8 hexadecimal digits, the same at every run."""
    steps = F.array_join(path.cast("array<string>"), ".")
    return F.substring(F.sha2(F.concat_ws("#", doc_id.cast("string"), steps), 256), 1, 8)


def parent_path(path: Column) -> Column:
    """Path of the parent, null for the root."""
    depth = F.size(path)
    return F.when(depth > 0, F.slice(path, F.lit(1), F.greatest(depth - 1, F.lit(0))))


def node_rows(df: DataFrame) -> DataFrame:
    """Complete rows that have doc_id, path, level, title, page_start, page_end and optionally raw_content."""
    path = F.col("path")
    raw = F.col("raw_content") if "raw_content" in df.columns else F.lit("").alias("raw_content")
    return df.select(
        "doc_id", node_id(F.col("doc_id"), path).alias("node_id"),
        F.when(F.size(path) > 0, node_id(F.col("doc_id"), parent_path(path))).alias("parent_id"),
        F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(0)).alias("ord"), F.size(path).alias("depth"), "path",
        "level", "title", "page_start", "page_end", F.lit("").alias("content_summary"), raw,
    )


def _empty_path() -> Column:
    return F.array().cast(PATH)


def root_nodes(docs: DataFrame) -> DataFrame:
    """Root rows of documents (doc_id, title, page_count)."""
    return node_rows(docs.select(
        "doc_id", "title", _empty_path().alias("path"), F.lit(0).alias("level"),
        F.lit(1).alias("page_start"), F.col("page_count").alias("page_end"),
    ))


def _leaf_nodes(pages: DataFrame, raw: Column) -> DataFrame:
    """One level-1 leaf per non-empty page; the page number serves as its place among the children."""
    number = F.col("page_number")
    return node_rows(pages.where(F.col("content") != "").select(
        "doc_id", F.array(number).alias("path"), F.lit(1).alias("level"),
        F.concat(F.lit(LEAF_TITLE), number.cast("string")).alias("title"),
        number.alias("page_start"), number.alias("page_end"), raw.alias("raw_content"),
    ))


def fallback_tree(docs: DataFrame, pages: DataFrame, raw_chars: int = RAW_CHARS_ERROR) -> DataFrame:
    """Root and one leaf per non-empty page of documents (doc_id, title, page_count); no shuffle."""
    return root_nodes(docs).unionByName(_leaf_nodes(pages, truncate(F.col("content"), raw_chars)))


def toc_requests(docs: DataFrame) -> DataFrame:
    """Add system and prompt to documents (doc_id, title, page_count, rollup); null without a roll-up."""
    prompt = F.concat(
        F.lit(TOC_PROMPT), F.lit("Title: "), "title", F.lit("\nPages: "), F.col("page_count").cast("string"),
        F.lit("\nPage summaries:\n"), F.nullif(F.col("rollup"), F.lit("")),
    )
    return docs.withColumn("system", F.lit(SYSTEM)).withColumn("prompt", prompt)


def _items(v: Column) -> Column:
    """What iterating a JSON value gives: null where that is an error.

    A missing value is the empty list; a string or an object iterates over
    characters or keys, none of which can be a section.
    """
    kind, text = variant_kind(v), variant_text(v)
    none = F.array().cast("array<variant>")
    return F.when(v.isNull(), none).when(kind == "ARRAY", v.try_cast("array<variant>")).when(
        text.isin("", "{}"), none
    )


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


_ENTRY = "title:string,titled:boolean,level:int,level_given:boolean,start:int,start_given:boolean,end:int,end_given:boolean"


def _entry(item: Column, *more: Column) -> Column:
    """Typed section or subsection; a given null is told apart from a missing field by its flag."""
    titled = (variant_kind(item) == "OBJECT") & _field(item, "title").isNotNull()
    fields = [variant_text(_field(item, "title")).alias("title"), F.coalesce(titled, F.lit(False)).alias("titled")]
    for key, name in (("level", "level"), ("page_start", "start"), ("page_end", "end")):
        fields += [variant_int(_field(item, key)).alias(name), _field(item, key).isNotNull().alias(f"{name}_given")]
    return F.struct(*fields, *more)


def decode_toc(responses: DataFrame) -> DataFrame:
    """First half of T2: add ``sections`` (typed array), null where the whole document must fall back.

    Every section and subsection needs a title, and a section with subsections
    both page numbers, since those are their defaults.
    """
    def section(s: Column) -> Column:
        subsections = _items(_field(s, "subsections"))
        return _entry(s, F.transform(subsections, lambda t: _entry(t)).cast(f"array<struct<{_ENTRY}>>").alias("subsections"))

    def valid(s: Column) -> Column:
        subs = s["subsections"]
        ranged = s["start_given"] & s["end_given"]
        return s["titled"] & F.coalesce((F.size(subs) == 0) | (ranged & F.forall(subs, lambda t: t["titled"])), F.lit(False))

    parsed = with_strict_json(responses, json_object_span(strip_think(F.col("response"))), "__data")
    typed = parsed.withColumn("__items", F.when(F.col("__data").isNotNull(), _items(_field(F.col("__data"), "sections")))) \
        .withColumn("__sections", F.transform("__items", section))
    return typed.withColumn("sections", F.when(F.forall("__sections", valid), F.col("__sections"))).drop(
        "__data", "__items", "__sections"
    )


def toc_nodes(decoded: DataFrame) -> DataFrame:
    """Second half of T2: nodes of documents (doc_id, title, page_count, sections) whose sections are usable.

    Everything about a document is in its row, so no shuffle is needed.
    """
    def given(name: str, default: Column) -> Column:
        return F.when(F.col(f"e.{name}_given"), F.col(f"e.{name}")).otherwise(default)

    docs = decoded.where(F.col("sections").isNotNull())
    sections = docs.select("doc_id", "page_count", F.posexplode("sections").alias("__i", "e")).select(
        "doc_id", F.array(F.col("__i") + 1).alias("path"), given("level", F.lit(1)).alias("level"), "e.title",
        given("start", F.lit(1)).alias("page_start"), given("end", F.col("page_count")).alias("page_end"), "e.subsections",
    )
    subsections = sections.select("doc_id", "path", "page_start", "page_end", F.posexplode("subsections").alias("__i", "e")).select(
        "doc_id", F.concat("path", F.array(F.col("__i") + 1)).alias("path"), given("level", F.lit(2)).alias("level"), "e.title",
        given("start", F.col("page_start")).alias("page_start"), given("end", F.col("page_end")).alias("page_end"),
    )
    return root_nodes(docs).unionByName(node_rows(sections.drop("subsections"))).unionByName(node_rows(subsections))


def plan_trees(docs: DataFrame, summaries: DataFrame, completer: Completer | None = None) -> DataFrame:
    """T5: documents (doc_id, title, page_count) with ``tree_source`` and ``sections``.

    ``tree_source`` is 'none' (no summary), 'toc' (model sections), 'error' (no
    usable model answer) or 'failed' (the roll-up itself failed: no tree). With a
    model the plan has several readers and is cut off from what made it; without
    one there are no ``sections``.
    """
    rolled = docs.select("doc_id", "title", "page_count").join(rollup_summaries(summaries), "doc_id", "left")
    failed, has_summary = F.coalesce("failed", F.lit(False)), F.coalesce("has_summary", F.lit(False))
    source = F.when(failed, "failed").when(~has_summary, "none")
    if not asks(completer):
        return rolled.select("doc_id", "title", "page_count", source.otherwise("error").alias("tree_source"))
    asked = toc_requests(rolled.withColumn("rollup", F.when(~failed, F.col("rollup"))))
    decoded = decode_toc(completer.attach(asked.drop("rollup")))
    return cut(decoded.select(
        "doc_id", "title", "page_count", "sections",
        source.when(F.col("sections").isNotNull(), "toc").otherwise("error").alias("tree_source"),
    ))


def build_tree(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes of all planned documents. Only a page's first characters reach the join."""
    source = F.col("tree_source")
    flat = planned.where(source.isin("none", "error"))
    heads = pages.where(F.col("content") != "").select(
        "doc_id", "page_number", truncate(F.col("content"), RAW_CHARS_ERROR).alias("content")
    )
    leaves = heads.join(flat.select("doc_id", "tree_source"), "doc_id")
    raw = F.when(source == "none", truncate(F.col("content"), RAW_CHARS_NO_SUMMARY)).otherwise(F.col("content"))
    nodes = root_nodes(flat).unionByName(_leaf_nodes(leaves, raw))
    if "sections" in planned.columns:
        nodes = nodes.unionByName(toc_nodes(planned.where(source == "toc")))
    return nodes


def tree_errors(planned: DataFrame) -> DataFrame:
    """Documents whose roll-up failed, with the message for the catalog."""
    return planned.where(F.col("tree_source") == "failed").select("doc_id", F.lit(TOPICS_ERROR).alias("error_message"))


_TREE_FIELDS = ("id", "title", "page_start", "page_end", "level", "content_summary", "raw_content")


def nest_tree(nodes: DataFrame) -> DataFrame:
    """One JSON tree per document of any depth, children in their order: (doc_id, index_tree, error_message).

    A document's nodes stand in one row, sorted by path, which is the pre-order;
    each writes its own fields behind the brackets that its depth closes or opens
    after the node before it. A document with a node whose parent is missing, with
    two nodes at one path, or without a root has an error in place of a tree.
    """
    fields = F.struct(F.col("node_id").alias("id"), *_TREE_FIELDS[1:])
    listed = nodes.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("path", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json")))).alias("__n")
    )

    def depth(i: Column) -> Column:
        """Depth of the node at place ``i``, -1 before the first one."""
        return F.when(i < 0, F.lit(-1)).otherwise(F.size(F.get("__n", i)["path"]))

    def written(n: Column, i: Column) -> Column:
        before, own = depth(i - 1), F.size(n["path"])
        up = F.when(i == 0, F.lit("")).when(own > before, F.lit("")).otherwise(F.concat(F.repeat(F.lit("]}"), before - own + 1), F.lit(",")))
        return F.concat(up, F.substring(n["json"], F.lit(1), F.length(n["json"]) - 1), F.lit(',"children":['))

    def placed(n: Column, i: Column) -> Column:
        """Whether the node's parent is on the way to the node before it, and the node is another one."""
        own, last = n["path"], F.get("__n", i - 1)["path"]
        above = F.greatest(F.size(own) - 1, F.lit(0))
        return F.when(i == 0, F.size(own) == 0).otherwise(
            (F.size(own) > 0) & (own != last) & (F.slice(last, F.lit(1), above) == F.slice(own, F.lit(1), above)) & (above <= F.size(last)))

    whole = F.forall(F.transform("__n", placed), lambda ok: ok)
    json = F.concat(F.array_join(F.transform("__n", written), ""), F.repeat(F.lit("]}"), depth(F.size("__n") - 1) + 1))
    return listed.select(
        "doc_id", F.when(whole, json).alias("index_tree"), F.when(~whole, F.lit("a node without its parent")).alias("error_message")
    )


def unnest_tree(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors) of JSON trees (doc_id, index_tree) of any depth; a missing id is made, missing texts are ''.

    One narrow step per level, until a level has no children; each is one job that
    stores the level and counts its children and faulty nodes. Parent ids come down
    with the children, so nothing is joined on the way, and trees without a fault
    are not joined at all. A tree that is no JSON object, or one of whose nodes lacks its
    title, pages or level, has no nodes but a row (doc_id, error_message).
    """
    def text(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "string")

    none = F.lit(None).cast("string")
    level = trees.select("doc_id", F.try_parse_json(F.col("index_tree")).alias("v"), _empty_path().alias("path"), none.alias("parent_id"))
    # What is no object has no title.
    incomplete = F.col("title").isNull() | F.col("page_start").isNull() | F.col("page_end").isNull() | F.col("level").isNull()
    listed, faults = [], []
    while True:
        seen = Observation()
        typed = cut(level.select(
            "doc_id", "path", "parent_id", F.coalesce(text("id"), node_id(F.col("doc_id"), F.col("path"))).alias("node_id"),
            text("level").try_cast("int").alias("level"), text("title").alias("title"),
            text("page_start").try_cast("int").alias("page_start"), text("page_end").try_cast("int").alias("page_end"),
            F.coalesce(text("content_summary"), F.lit("")).alias("content_summary"), F.coalesce(text("raw_content"), F.lit("")).alias("raw_content"),
            F.try_variant_get("v", "$.children", "array<variant>").alias("__children"),
        ).observe(seen, F.coalesce(F.sum(F.coalesce(F.array_size("__children"), F.lit(0))), F.lit(0)).alias("children"),
                  F.count_if(incomplete).alias("faults")))
        listed.append(typed.drop("__children"))
        if seen.get["faults"]:
            faults.append(typed.where(incomplete).select("doc_id"))
        if not seen.get["children"]:
            break
        level = typed.select("doc_id", "path", "node_id", F.posexplode_outer("__children").alias("__i", "v")).where(F.col("__i").isNotNull()).select(
            "doc_id", "v", F.concat("path", F.array(F.col("__i") + 1)).alias("path"), F.col("node_id").alias("parent_id"))
    faulty = stored(reduce(DataFrame.union, faults or [listed[0].where(F.lit(False)).select("doc_id")]).distinct(), "faulty")
    nodes = reduce(DataFrame.union, listed)
    nodes = nodes.join(faulty, "doc_id", "left_anti") if faults else nodes
    return (
        nodes.withColumn("depth", F.size("path")).withColumn("ord", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0))).select(*NODE_COLUMNS),
        faulty.select("doc_id", F.lit("the tree is no JSON, or a node lacks its title, pages or level").alias("error_message")),
    )


def preorder(nodes: DataFrame) -> DataFrame:
    """All nodes, parents before their children."""
    return nodes.orderBy("doc_id", "path")


def tree_text(nodes: DataFrame) -> DataFrame:
    """The tree as indented text, one line per node in pre-order."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(NO_VALUE))

    before, after, pages, to, end = map(F.lit, TREE_LINE)
    line = F.concat(
        F.repeat(F.lit(INDENT), F.col("depth")), before, shown("level"), after, shown("title"),
        pages, shown("page_start"), to, shown("page_end"), end,
    )
    return nodes.select("doc_id", "path", line.alias("__line")).groupBy("doc_id").agg(
        F.expr("listagg(__line, '') WITHIN GROUP (ORDER BY path)").alias("tree_text")
    )


def public_nodes(nodes: DataFrame) -> DataFrame:
    """What a reader of the catalog is shown: no summary and no text."""
    return nodes.drop("content_summary", "raw_content")


def node_counts(nodes: DataFrame) -> DataFrame:
    """T12."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("node_count"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Number of children of every node, 0 for leaves."""
    counts = nodes.where(F.size("path") > 0).groupBy("doc_id", parent_path(F.col("path")).alias("path")).agg(
        F.count("*").alias("child_count")
    )
    return nodes.select("doc_id", "node_id", "path", "title").join(counts, ["doc_id", "path"], "left").select(
        "doc_id", "node_id", "path", "title", F.coalesce("child_count", F.lit(0)).alias("child_count")
    )


def ancestors(nodes: DataFrame, selected: DataFrame, as_shipped: bool = False) -> DataFrame:
    """The nodes from the root to each selected node (doc_id, path), which are shown expanded.

    ``highlighted`` is true for strict ancestors. With ``as_shipped`` only the
    selected node itself is given: its mark never reached the levels above.
    """
    depth = F.size("path")
    first = depth if as_shipped else F.lit(0)
    wanted = selected.select("doc_id", F.col("path").alias("selected_path")).withColumn("path", F.col("selected_path"))
    steps = wanted.select(
        "doc_id", "selected_path",
        F.explode(F.transform(F.sequence(first, depth), lambda k: F.slice("path", F.lit(1), k))).alias("path"),
    )
    return nodes.join(steps, ["doc_id", "path"]).select(
        "doc_id", "selected_path", "node_id", "path", "title", "level",
        (F.size("path") < F.size("selected_path")).alias("highlighted"),
    )


def heading_tree(lines: DataFrame, docs: DataFrame, max_level: int = MAX_HEADING_LEVEL) -> DataFrame:
    """The tree of '#' headings as nodes, from lines (doc_id, line_no, page_number, line, last_page, fenced) and documents (doc_id, title, page_count).

    Every document has its root. The parent of a heading is the nearest earlier
    one of a lower level, else the root. A heading ends on the page of the next
    heading of its own or a lower level, else on the last page. Lines between code
    fences are no headings. Only headings and roots are shuffled, once, by document,
    and what groups the nodes by document needs no shuffle of its own; all else
    are running maxima and minima of one number or pair per level, over windows
    that are sorted within that partitioning and spill, so a document of very many
    headings takes time and memory in proportion.
    """
    mark = r"^(#{1,%d})\s+(.*\S)\s*$" % max_level
    heads = lines.where(~F.col("fenced") & F.col("line").startswith("#") & F.col("line").rlike(mark)).select(
        "doc_id", "line_no", F.length(F.regexp_extract("line", mark, 1)).alias("level"),
        F.regexp_extract("line", mark, 2).alias("title"), F.col("page_number").alias("page_start"), "last_page",
    )
    # A root goes before all headings, and is none of the levels that they look for.
    heads = heads.unionByName(docs.select(
        "doc_id", F.lit(-1).alias("line_no"), F.lit(0).alias("level"), "title", F.lit(1).alias("page_start"), F.col("page_count").alias("last_page")))
    levels = range(1, max_level + 1)
    level = F.col("level")

    def down(*order: Column) -> WindowSpec:
        return Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def at(k: int, value: Column) -> Column:
        return F.when(level == k, value)

    def over_levels(pick, columns: list[Column]) -> Column:
        return pick(F.lit(None), F.lit(None), *columns)

    # The nearest following heading of each level, seen from the end, and the nearest one before.
    following, before = down(F.col("line_no").desc()), down(F.col("line_no"))
    ended = heads.withColumns({f"__next{k}": F.min(at(k, F.struct("line_no", "page_start"))).over(following) for k in levels})
    ended = ended.withColumn("page_end", F.coalesce(
        over_levels(F.least, [F.when(level >= k, F.col(f"__next{k}")) for k in levels])["page_start"], F.col("last_page")))
    parents = ended.select("doc_id", "line_no", "level", "title", "page_start", "page_end", *[F.max(at(k, F.col("line_no"))).over(before).alias(f"__line{k}") for k in levels])
    parents = parents.withColumn("__parent", over_levels(F.greatest, [F.when(level > k, F.col(f"__line{k}")) for k in levels]))
    placed = parents.withColumn("__place", F.row_number().over(Window.partitionBy("doc_id", "__parent", level == 0).orderBy("line_no")))
    # A heading is still open if no lower level has come since; the open ones are the way to the next heading.
    way = placed.withColumns({f"__last{k}": F.max(at(k, F.struct("line_no", "__place"))).over(before) for k in levels})

    def open_at(k: int) -> Column:
        lower = over_levels(F.greatest, [F.col(f"__last{j}.line_no") for j in range(1, k)])
        return F.coalesce((level > k) & (F.col(f"__last{k}.line_no") > F.coalesce(lower, F.lit(-1))), F.lit(False))

    steps = [F.when(open_at(k), F.array(F.col(f"__last{k}.__place"))).otherwise(_empty_path()) for k in levels]
    path = F.when(level == 0, _empty_path()).otherwise(F.concat(*steps, F.array("__place")))
    return node_rows(way.select("doc_id", path.alias("path"), "level", "title", "page_start", "page_end"))
