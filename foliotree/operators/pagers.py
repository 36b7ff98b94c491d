"""Pagination: a document is one row, its pages are rows.

A pager is narrow: the pages of a document come out of the row that holds the
document, so no pager shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliotree.functions.text import WHITESPACE, strip

# Page widths in characters, and the shortest usable layout extraction.
FIXED_WIDTH = 3000
LINE_CAP = 4000
PARAGRAPH_THRESHOLD = 3000
MIN_EXTRACTION = 50

# A page never ends on a line that starts or ends like this.
LIST_MARK = "-"
FENCE_MARK = "```"

PAGE_COLUMNS = ("doc_id", "page_number", "content", "char_count")


def page_fixed(df: DataFrame, text: str = "text", width: int = FIXED_WIDTH) -> DataFrame:
    """Consecutive slices of ``width`` code points, the last one partial; no page for ''.

    One linear regular-expression pass; taking substrings by offset would walk
    the text from its start for every page.
    """
    slices = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % width), F.lit(0))
    return _exploded(df.select("doc_id", F.posexplode_outer(slices).alias("__pos", "content"))).select(
        "doc_id",
        (F.col("__pos") + 1).alias("page_number"),
        "content",
        F.length("content").alias("char_count"),
    )


def _exploded(df: DataFrame) -> DataFrame:
    """Rows of an outer posexplode without those of empty arrays.

    The inner posexplode would make the optimizer test the array for emptiness
    below it, which computes an expensive array twice.
    """
    return df.where(F.col("__pos").isNotNull())


# Items folded before the list of spans is touched.
_BLOCK = 512


def _fold_spans(items: str, size: str, limit: int, breaks_before: str = "false", holds_open: str = "false") -> Column:
    """Greedy packing of the column ``items`` into spans (first index, number of items, total size).

    ``size``, ``breaks_before`` and ``holds_open`` are SQL expressions of one item
    ``x``. A span closes as soon as its size reaches ``limit`` unless
    ``holds_open``; ``breaks_before`` closes a non-empty span ahead of the item.
    The state holds indexes and sizes, no text. ``aggregate`` copies its state for
    every item, so the items are folded in blocks with the few spans of a block in
    the state, and the long list of all spans is copied per block. A one-element
    array under ``transform`` gives an intermediate result its name.
    """
    none = "cast(array() AS array<struct<first:int,n:int,chars:bigint>>)"

    def closed(at: str, acc: str) -> str:
        return f"concat({acc}.spans, array(named_struct('first', {acc}.first, 'n', {at} - {acc}.first, 'chars', {acc}.chars)))"

    opened = f"""transform(array(
        if(a.at > a.first AND ({breaks_before}),
           named_struct('first', a.at, 'chars', bigint({size}), 'spans', {closed('a.at', 'a')}),
           named_struct('first', a.first, 'chars', a.chars + ({size}), 'spans', a.spans))), b ->
        if(b.chars >= {limit} AND NOT ({holds_open}),
           named_struct('at', a.at + 1, 'first', a.at + 1, 'chars', 0L, 'spans', {closed('a.at + 1', 'b')}),
           named_struct('at', a.at + 1, 'first', b.first, 'chars', b.chars, 'spans', b.spans)))[0]"""
    block = f"""transform(array(aggregate(slice({items}, start + 1, {_BLOCK}),
        named_struct('at', s.at, 'first', s.first, 'chars', s.chars, 'spans', {none}), (a, x) -> {opened})), f ->
        named_struct('at', f.at, 'first', f.first, 'chars', f.chars, 'spans', concat(s.spans, f.spans)))[0]"""
    return F.expr(f"""aggregate(sequence(0, greatest(size({items}) - 1, 0), {_BLOCK}),
        named_struct('at', 0, 'first', 0, 'chars', 0L, 'spans', {none}), (s, start) -> {block},
        s -> if(s.at > s.first, {closed('s.at', 's')}, s.spans))""")


def _line_fold(lines: str, cap: int) -> Column:
    bare = f"btrim(x, '{WHITESPACE}')"
    guarded = f"startswith({bare}, '{LIST_MARK}') OR startswith({bare}, '{FENCE_MARK}') OR endswith({bare}, '{FENCE_MARK}')"
    return _fold_spans(lines, "length(x) + 1", cap, breaks_before=f"length(x) > {cap}", holds_open=guarded)


def _line_spans(df: DataFrame, text: str, cap: int) -> DataFrame:
    """``doc_id``, the lines of each text and their spans, one row per document; both null where the text is.

    A test for null would make the optimizer compute an expensive text twice.
    """
    return df.select("doc_id", F.split(F.col(text), "\n", -1).alias("__lines")).withColumn("__spans", _line_fold("__lines", cap))


def _fenced(lines: str) -> Column:
    """Of every line whether it is a fence or stands behind an odd number of them.

    Stretches between fences alternate, so one pass over the fences writes them
    all: what a text costs does not grow with lines times fences.
    """
    fences = f"filter(sequence(0, size({lines}) - 1), i -> startswith(btrim({lines}[i], '{WHITESPACE}'), '{FENCE_MARK}'))"
    ends = f"transform(array({fences}), f -> concat(array(-1), f, array(size({lines}))))[0]"
    return F.expr(f"""transform(array({ends}), e -> flatten(transform(sequence(0, size(e) - 2), j ->
        if(j = size(e) - 2, array_repeat(j % 2 = 1, e[j + 1] - e[j] - 1), concat(array_repeat(j % 2 = 1, e[j + 1] - e[j] - 1), array(true))))))[0]""")


def _span_items(items: str) -> Column:
    return F.slice(F.col(items), F.col("__span.first") + 1, F.col("__span.n"))


def page_lines(df: DataFrame, text: str = "text", cap: int = LINE_CAP) -> DataFrame:
    """Pack whole lines into pages of at least ``cap`` characters, keeping lists and fences together.

    ``char_count`` counts one newline per line, so it is one more than the
    length of the content.
    """
    spans = _line_spans(df, text, cap).select("doc_id", "__lines", F.posexplode_outer("__spans").alias("__pos", "__span"))
    return _exploded(spans).select(
        "doc_id",
        (F.col("__pos") + 1).alias("page_number"),
        F.array_join(_span_items("__lines"), "\n").alias("content"),
        F.col("__span.chars").cast("int").alias("char_count"),
    )


def doc_lines(df: DataFrame, text: str = "text", cap: int = LINE_CAP) -> DataFrame:
    """Every line with its number (from 0), the page of :func:`page_lines` it is on, the document's last page, and whether
    it stands between code fences (an odd number of fence lines before it) or is one."""
    pages = F.flatten(F.transform("__spans", lambda s, p: F.array_repeat(p + 1, s["n"])))
    lined = _line_spans(df, text, cap).select(
        "doc_id", F.size("__spans").alias("last_page"),
        F.arrays_zip(F.col("__lines").alias("line"), pages.alias("page_number"), _fenced("__lines").alias("fenced")).alias("__all"),
    )
    return lined.select("doc_id", "last_page", F.posexplode_outer("__all").alias("__pos", "__l")).transform(_exploded).select(
        "doc_id", F.col("__pos").alias("line_no"), "__l.page_number", "__l.line", "last_page", "__l.fenced")


def page_paragraphs(df: DataFrame, paragraphs: str = "paragraphs", threshold: int = PARAGRAPH_THRESHOLD,
                    exact: bool = False, with_exact: bool = False) -> DataFrame:
    """Pack non-blank stripped paragraphs, each followed by a newline.

    ``df`` holds one row per document with its paragraphs in an array, the way a
    decoder emits them, so nothing has to be gathered. By default only a last,
    unfilled page carries a ``char_count`` and all others 0; ``exact`` counts every
    page, and ``with_exact`` adds that as ``exact_count``. The count leaves the newlines out.
    """
    bare = F.filter(F.transform(F.col(paragraphs), lambda p: strip(p)), lambda p: p != "")
    chars = F.col("__span.chars")
    return (
        df.select("doc_id", bare.alias("__items"))
        .withColumn("__spans", _fold_spans("__items", "length(x)", threshold))
        .select("doc_id", "__items", F.posexplode_outer("__spans").alias("__pos", "__span"))
        .transform(_exploded)
        .select(
            "doc_id",
            (F.col("__pos") + 1).alias("page_number"),
            F.concat(F.array_join(_span_items("__items"), "\n"), F.lit("\n")).alias("content"),
            (chars if exact else F.when(chars >= threshold, 0).otherwise(chars)).cast("int").alias("char_count"),
            *([chars.cast("int").alias("exact_count")] if with_exact else []),
        )
    )


def page_physical(raw_pages: DataFrame) -> DataFrame:
    """Normalise decoded pages (doc_id, idx from 0, text); the count is that of the unstripped text."""
    return raw_pages.select(
        "doc_id",
        (F.col("idx") + 1).cast("int").alias("page_number"),
        F.coalesce(strip(F.col("text")), F.lit("")).alias("content"),
        F.coalesce(F.length("text"), F.lit(0)).alias("char_count"),
    )


def _case_pages(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Pages of rows (doc_id, file_type, …) in one pass: ``kinds`` says which of fixed, paragraphs and extraction a type takes.

    A document's pages are one array, made by the expression of its type and
    exploded once, so the rows are read once whatever types they have.
    """
    def of(kind: str) -> Column:
        return F.col("file_type").isin([ext for ext, k in kinds.items() if k == kind])

    rich = of("extraction") & F.coalesce(F.length(strip(F.col("rich_text"))) >= MIN_EXTRACTION, F.lit(False))
    bare = F.filter(F.transform("paragraphs", lambda p: strip(p)), lambda p: p != "")
    page = lambda content, chars: F.struct(content.alias("content"), chars.cast("int").alias("char_count"))
    staged = df.where(F.col("file_type").isin(list(kinds))).select(
        "doc_id", of("fixed").alias("__fixed"), of("paragraphs").alias("__para"), "text", "raw_pages",
        F.when(rich, F.split("rich_text", "\n", -1)).alias("__lines"), F.when(of("paragraphs"), bare).alias("__items"),
    )
    staged = staged.withColumn("__lspans", F.when(F.col("__lines").isNotNull(), _line_fold("__lines", LINE_CAP))).withColumn(
        "__pspans", F.when(F.col("__items").isNotNull(), _fold_spans("__items", "length(x)", PARAGRAPH_THRESHOLD)))

    def items(name: str, span: Column) -> Column:
        return F.slice(F.col(name), span["first"] + 1, span["n"])

    fixed = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % FIXED_WIDTH), F.lit(0)), lambda t: page(t, F.length(t)))
    lines = F.transform("__lspans", lambda s: page(F.array_join(items("__lines", s), "\n"), s["chars"]))
    paragraphs = F.transform("__pspans", lambda s: page(
        F.concat(F.array_join(items("__items", s), "\n"), F.lit("\n")), F.when(s["chars"] >= PARAGRAPH_THRESHOLD, 0).otherwise(s["chars"])))
    physical = F.transform("raw_pages", lambda t: page(F.coalesce(strip(t), F.lit("")), F.coalesce(F.length(t), F.lit(0))))
    pages = F.when(F.col("__fixed"), fixed).when(F.col("__para"), paragraphs).when(F.col("__lines").isNotNull(), lines).otherwise(physical)
    return _exploded(staged.select("doc_id", F.posexplode_outer(pages).alias("__pos", "__page"))).select(
        "doc_id", (F.col("__pos") + 1).alias("page_number"), "__page.content", "__page.char_count")


def prefer_extraction(df: DataFrame, rich: str = "rich_text", plain: str = "raw_pages",
                      min_chars: int = MIN_EXTRACTION, cap: int = LINE_CAP) -> DataFrame:
    """Line pages of the layout extraction when it is long enough, else the plain pages.

    Both extractions of a document stand in its row (``plain`` is an array of
    page texts), so the choice needs no join.
    """
    usable = F.coalesce(F.length(strip(F.col(rich))) >= min_chars, F.lit(False))
    plain_rows = df.where(~usable).select("doc_id", F.posexplode(plain).alias("idx", "text"))
    return page_lines(df.where(usable), text=rich, cap=cap).unionByName(page_physical(plain_rows))


def page_counts(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """P5: number of pages per catalog document, zero included."""
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    return catalog.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("page_count", F.lit(0)).alias("page_count")
    )


Pager = Callable[[DataFrame], DataFrame]


class PagerRegistry:
    """File type → pager. A pager takes decoded document rows and returns page rows.

    Decoded rows carry doc_id, file_type and whichever of ``text``, ``rich_text``,
    ``raw_pages`` and ``paragraphs`` their pager reads.
    """

    def __init__(self) -> None:
        self._pagers: dict[str, Pager] = {
            ".pdf": prefer_extraction,
            ".docx": page_paragraphs,
            ".txt": page_fixed,
            ".md": page_fixed,
        }

    def register_pager(self, ext: str, pager: Pager) -> None:
        self._pagers[ext.lower()] = pager

    @property
    def types(self) -> list[str]:
        return list(self._pagers)

    def paginate(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pages, errors): each type through its pager, unknown types as error rows.

        The pagers of this module read ``df`` once together; each pager that was
        registered on top filters ``df`` for its types.
        """
        by_pager: dict[Pager, list[str]] = {}
        for ext, pager in self._pagers.items():
            by_pager.setdefault(pager, []).append(ext)
        together = {page_fixed: "fixed", page_paragraphs: "paragraphs", prefer_extraction: "extraction"}
        kinds = {ext: together[pager] for pager, exts in by_pager.items() if pager in together for ext in exts}
        parts = [_case_pages(df, kinds).select(*PAGE_COLUMNS)] if kinds else []
        parts += [
            pager(df.where(F.col("file_type").isin(exts))).select(*PAGE_COLUMNS)
            for pager, exts in by_pager.items() if pager not in together
        ]
        pages = parts[0]
        for part in parts[1:]:
            pages = pages.unionByName(part)
        unknown = ~F.coalesce(F.col("file_type").isin(self.types), F.lit(False))
        errors = df.where(unknown).select(
            "doc_id", F.concat(F.lit("Unsupported file type: "), F.coalesce("file_type", F.lit(""))).alias("error_message")
        )
        return pages, errors


default_registry = PagerRegistry()
register_pager = default_registry.register_pager
paginate = default_registry.paginate
