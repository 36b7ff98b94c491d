"""Packing against the tokenizer itself, and its edge rows."""

import struct
import zlib
from collections import defaultdict

import pytest

from foliotree.llm import packing
from foliotree.llm.queries import vocabulary

TEXTS = ["The End, the END.", "", None, "naïve Σίσυφος ß 12 3,5 don't </w> <|endoftext|> x́y z\x1cq", "a b " * 900, "word\n" * 3000, "İstanbul ﬁne १२"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


def expected_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_the_text(tokenizer):
    own = packing.WordTokenizer(vocabulary())
    for texts in (TEXTS, TEXTS):  # the second time from the cache
        got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in own.batch(texts)]
        assert got == [expected_ids(tokenizer, t)[:-1] for t in texts]


def check(rows, ids_of, capacity):
    """Every id in one piece, every sequence gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, sequence, offset in rows:
        by_doc[doc_id].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    for doc_id, pieces in by_doc.items():
        ids = ids_of[doc_id]
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and length > 0 and total == len(ids)
            part = ids[start : start + length]
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *part))
            at += length
        assert at == len(ids)
    assert set(by_doc) == set(ids_of)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_all_ids_once(spark, tokenizer):
    data = [(i, TEXTS[i % len(TEXTS)], "x", 1) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, length string, sequence_id int").repartition(5)
    rows = [tuple(r) for r in packing.pack(docs, vocabulary(), capacity=256, open_windows=3, cut_gap=16).collect()]
    ids = {i: expected_ids(tokenizer, t) for i, t, *_ in data}
    sequences = check(rows, ids, 256)
    tokens = sum(map(len, ids.values()))
    assert sequences <= tokens / 256 * 1.1 + 3


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c")], "doc_id long, text string")
    rows = packing.pack(docs, vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 3), (1, 2), (1, 2)]
    assert len({r.sequence_id for r in rows}) == 1
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_windows_are_bounded_and_best_fitting():
    windows = packing.OpenWindows(10, 2, None, 0)
    for n, size in enumerate([6, 7, 3, 4, 9]):
        windows.add(n, 0, size, size, lambda a, b: 0)
        assert len(windows.rooms) <= 2
    done = [(r[0], r[5]) for r in windows.take_done()]
    assert done == [(1, 0), (2, 0), (0, 1), (3, 1)]  # 3 into the room of 3, 4 into that of 4
    assert [[p[0] for p in pieces] for _, pieces in windows.leftovers()] == [[4]]
    windows = packing.OpenWindows(10, 1, None, 0)
    windows.add(0, 0, 6, 6, lambda a, b: 0)
    windows.add(1, 0, 6, 6, lambda a, b: 0)  # does not fit: the only window is emitted
    assert [r[0] for r in windows.take_done()] == [0]
