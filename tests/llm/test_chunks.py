"""Exact deduplication by chunk recipes."""

import random
import re

from pyspark.sql import functions as F

from foliotree.llm import chunk_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(BLANKS.sub(" ", text or ""), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[BLANKS.sub(" ", text or "")]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choice(["the", "sea,", "lion.", "ñandú", "😀", "12"]) for _ in range(n))
    long = prose(9000)
    rows = [(10, long), (3, long.replace(" ", "\n\t")), (4, long[:-1] + "!"), (5, "x" * 30000), (6, "x" * 30000), (7, "x" * 29999)]
    rows += [(20, None), (21, ""), (22, " \n"), (23, " "), (None, "n"), (None, "n"), (24, "twin"), (24, "twin"), (25, "a b"), (25, "a  b"), (26, "a b")]
    return rows + [(100 + i, prose(draw.randint(1, 400))) for i in range(60)]


def test_equals_grouping_by_text(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, h int, list string")
    got = chunk_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected(rows)


def test_colliding_hashes_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = lambda c: F.pmod(F.length(c), F.lit(5)).cast("bigint")
    got = chunk_dedup.deduplicate(docs, low=64, high=512, hash_of=bad).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected(rows)


def test_chunks_are_the_text_and_follow_the_content(spark):
    draw = random.Random(8)
    text = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(9000))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(chunk_dedup.chunks(F.col("t"))).first()[0]
    whole, shifted = cut(text), cut("Something else in front. " + text)
    assert "".join(whole) == text and all(len(c) <= chunk_dedup.MAX_CHUNK for c in whole)
    assert len(whole) > 20 and len(set(whole) & set(shifted)) >= len(whole) - 8  # only the front differs
    plain = "😀 ñ " * 9000
    assert "".join(cut(plain)) == plain
    assert cut("") == []


def test_kept_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, "b", 3)], "doc_id long, text string, kept int")
    assert sorted(tuple(r) for r in chunk_dedup.kept_rows(docs).collect()) == [(1, "a", 2), (3, "b", 3)]
    assert chunk_dedup.deduplicate(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = chunk_dedup.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
