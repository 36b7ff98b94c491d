import random

import pytest
from pyspark.sql import functions as F

from foliotree.operators import pagers


def pages_of(df):
    out = {}
    for r in df.orderBy("doc_id", "page_number").collect():
        out.setdefault(r.doc_id, []).append((r.page_number, r.content, r.char_count))
    return out


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_fixed_edges(spark):
    out = pages_of(pagers.page_fixed(docs(spark, ["", "abc", "abcd", "é😀xy", None, "a\nb\n\n"]), width=3))
    assert out == {
        1: [(1, "abc", 3)], 2: [(1, "abc", 3), (2, "d", 1)], 3: [(1, "é😀x", 3), (2, "y", 1)],
        5: [(1, "a\nb", 3), (2, "\n\n", 2)],
    }


def test_fixed_pages_put_together_are_the_text(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aé😀 \n") for _ in range(rnd.randrange(0, 9500))) for _ in range(60)]
    out = pages_of(pagers.page_fixed(docs(spark, texts)))
    for i, text in enumerate(texts):
        pages = out.get(i, [])
        assert "".join(c for _, c, _ in pages) == text
        assert [n for n, _, _ in pages] == list(range(1, len(pages) + 1))
        assert all(k == len(c) for _, c, k in pages) and all(k == 3000 for _, _, k in pages[:-1])


LINE_CASES = [
    ("", [("", 1)]),
    ("abc", [("abc", 4)]),
    ("abcd\nefgh\nij", [("abcd\nefgh", 10), ("ij", 3)]),
    ("ab\nabcdefghijklm\ncd", [("ab", 3), ("abcdefghijklm", 14), ("cd", 3)]),
    ("abcd\n- item1\n- it2\nend", [("abcd\n- item1\n- it2\nend", 23)]),
    ("x\n```\ncode5678\n```\nz", [("x\n```\ncode5678", 15), ("```\nz", 6)]),
    ("abcdefghi", [("abcdefghi", 10)]),
    ("abcdefghi\n", [("abcdefghi", 10), ("", 1)]),
    ("é😀abcdefg\nk", [("é😀abcdefg", 10), ("k", 2)]),
]


def test_line_edges(spark):
    out = pages_of(pagers.page_lines(docs(spark, [t for t, _ in LINE_CASES]), cap=10))
    assert [[(c, k) for _, c, k in out[i]] for i in range(len(LINE_CASES))] == [e for _, e in LINE_CASES]


def packed(lines, cap):
    """Independent packing by position: where does the page that starts at line ``at`` end?"""
    def end(at):
        total = 0
        for k in range(at, len(lines)):
            if len(lines[k]) > cap and k > at:
                return k
            total += len(lines[k]) + 1
            bare = lines[k].strip()
            if total >= cap and not (bare[:1] == "-" or bare[:3] == "```" or bare[-3:] == "```"):
                return k + 1
        return len(lines)

    at = 0
    while at < len(lines):
        stop = end(at)
        yield lines[at:stop]
        at = stop


def test_line_packing_against_a_plain_loop(spark):
    rnd = random.Random(2)
    words = ["- a", "```", "x" * 3, "", "  - b", "code ```", "y" * 12, "z" * 25, "é😀", "\t```py"]
    texts = ["\n".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(200)]
    out = pages_of(pagers.page_lines(docs(spark, texts), cap=20))
    for i, text in enumerate(texts):
        expected = [("\n".join(p), sum(len(x) + 1 for x in p)) for p in packed(text.split("\n"), 20)]
        assert [(c, k) for _, c, k in out[i]] == expected
        assert "\n".join(c for _, c, _ in out[i]) == text


def test_doc_lines_agree_with_pages(spark):
    texts = [t for t, _ in LINE_CASES]
    lines = pagers.doc_lines(docs(spark, texts), cap=10)
    joined = lines.groupBy("doc_id", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content")
    )
    pages = pagers.page_lines(docs(spark, texts), cap=10).select("doc_id", "page_number", "content")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, pages.collect()))
    assert lines.count() == sum(t.count("\n") + 1 for t in texts)


def test_paragraph_edges(spark):
    cases = [[], ["  ", "\n"], ["abc"], ["abcde", "fghij", "k"], [" abcde ", "", "fghij"]]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, paragraphs array<string>")
    shipped, exact = (pages_of(pagers.page_paragraphs(df, threshold=8, exact=e)) for e in (False, True))
    assert shipped == {
        2: [(1, "abc\n", 3)], 3: [(1, "abcde\nfghij\n", 0), (2, "k\n", 1)], 4: [(1, "abcde\nfghij\n", 0)],
    }
    assert exact[3] == [(1, "abcde\nfghij\n", 10), (2, "k\n", 1)] and exact[4] == [(1, "abcde\nfghij\n", 10)]


def test_physical_pages(spark, rows):
    raw = spark.createDataFrame([(1, 0, None), (1, 1, "  x \n")], "doc_id int, idx int, text string")
    assert rows(pagers.page_physical(raw)) == [(1, 1, "", 0), (1, 2, "x", 5)]


def test_extraction_preference(spark):
    df = spark.createDataFrame([
        (1, "r" * 50, ["plain"]), (2, " " + "r" * 49 + " ", ["plain"]), (3, None, [" a ", None]),
    ], "doc_id int, rich_text string, raw_pages array<string>")
    assert pages_of(pagers.prefer_extraction(df)) == {
        1: [(1, "r" * 50, 51)], 2: [(1, "plain", 5)], 3: [(1, "a", 3), (2, "", 0)],
    }


def test_dispatch_and_custom_pager(spark):
    schema = "doc_id int, file_type string, text string, rich_text string, raw_pages array<string>, paragraphs array<string>"
    df = spark.createDataFrame([
        (1, ".txt", "t", None, None, None), (2, ".md", "# m", None, None, None), (3, ".pdf", None, None, ["p"], None),
        (4, ".docx", None, None, None, ["d"]), (5, ".bin", "b", None, None, None), (6, None, "n", None, None, None),
    ], schema)
    registry = pagers.PagerRegistry()
    pages, errors = registry.paginate(df)
    assert {k: v[0][1] for k, v in pages_of(pages).items()} == {1: "t", 2: "# m", 3: "p", 4: "d\n"}
    assert {r.doc_id: r.error_message for r in errors.collect()} == {5: "Unsupported file type: .bin", 6: "Unsupported file type: "}
    registry.register_pager(".BIN", lambda d: pagers.page_fixed(d, width=1))
    pages, errors = registry.paginate(df)
    assert pages_of(pages)[5] == [(1, "b", 1)] and [r.doc_id for r in errors.collect()] == [6]


def test_page_counts_include_zero(spark, rows):
    catalog = spark.createDataFrame([(0,), (1,), (2,)], "doc_id int")
    assert rows(pagers.page_counts(catalog, pagers.page_fixed(docs(spark, ["", "abcd", "a"]), width=3))) == [(0, 0), (1, 2), (2, 1)]


@pytest.mark.parametrize("pager", [pagers.page_fixed, pagers.page_lines, pagers.doc_lines])
def test_pagers_do_not_shuffle(spark, pager):
    plan = pager(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_very_long_text_is_linear(spark):
    df = spark.range(1).select(F.lit(0).alias("doc_id"), F.expr("repeat('0123456789abcde😀\n', 300000)").alias("text"))
    got = pagers.page_fixed(df).agg(F.count("*"), F.sum("char_count")).first()
    assert tuple(got) == (1700, 5_100_000)
    got = pagers.page_lines(df).agg(F.max("page_number"), F.sum("char_count")).first()
    # 236 lines of 17 characters reach 4000; the text has 300,000 of them and an empty last one.
    assert tuple(got) == (-(-300_001 // 236), 5_100_001)
