"""Repeated passages against a plain comparison of all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from foliotree.llm.rlz_spans import ReferenceBlock, _WordHashes, anchors, digests, passages, without_repeats

SCHEMA = "doc_id long, text string, kept string, spans int, digest int"


def slow(data, window):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in data]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if least[tuple(words[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, window, alphabet=40, n=70):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randint(0, alphabet)
    shared = [" ".join(word() for _ in range(draw.randint(window // 2, 4 * window))) for _ in range(6)]
    data = [(None, shared[0]), (None, shared[0]), (500, None), (501, ""), (502, "  \n"), (503, shared[0] + "\t" + shared[0]), (503, shared[1]), (503, shared[1])]
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 5)):
            if draw.random() < 0.6:
                passage = draw.choice(shared).split()
                a = draw.randint(0, len(passage) // 2)
                parts += passage[a : draw.randint(len(passage) // 2, len(passage))]
            else:
                parts += [word() for _ in range(draw.randint(0, 2 * window))]
        data.append((draw.randint(0, 60) if draw.random() < 0.2 else 1000 - i, draw.choice([" ", "\n ", "\x0b"]).join(parts)))
    return data + data[:12]


@pytest.mark.parametrize("seed,window,shingle,hot,block,alphabet", [
    (1, 8, 3, 1024, 4096, 40), (2, 8, 3, 3, 20, 40), (3, 5, 2, 4, 8, 3), (4, 50, 10, 1024, 4096, 500), (5, 6, 6, 1024, 30, 4), (6, 6, 1, 0, 1, 8),
])
def test_against_all_windows(spark, rows, seed, window, shingle, hot, block, alphabet):
    data = made_up(seed, window, alphabet)
    docs = spark.createDataFrame([(i, t, "no", 1, 2) for i, t in data], SCHEMA).repartition(4)
    got = without_repeats(docs, window=window, shingle=shingle, hot=hot, block=block)
    expected = slow(data, window)
    assert rows(digests(got)) == expected
    assert 20 < sum(n > 0 for _, _, n, _ in expected) < len(expected)


def test_spans_are_what_is_removed(spark):
    text = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, text), (2, "a b " + " ".join(text.split()[100:170]) + " c"), (3, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert found[1].spans == [] and [tuple(s) for s in found[2].spans] == [(2, 72)] and [tuple(s) for s in found[3].spans] == [(0, 300)]
    assert found[2].kept == "a b c" and found[3].kept == "" and found[1].kept == text


def test_49_words_stay(spark):
    base = [f"w{k}" for k in range(100)]
    data = [(1, " ".join(base)), (2, " ".join(["x", *base[10:59], "y"])), (3, " ".join(["u", *base[10:60], "v"]))]
    found = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0, 3: 50}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=12), st.integers(1, 6), st.data())
def test_block_finds_every_window(texts, window, data):
    ids = data.draw(st.lists(st.integers(0, 4), min_size=len(texts), max_size=len(texts)))
    block = ReferenceBlock([b" ".join(b"%d" % x for x in t) for t in texts], np.array(ids))
    got = {(p, k) for p, a, b in block.spans(window) for k in range(a, b + 1)}
    grams = [[tuple(t[k : k + window]) for k in range(len(t) - window + 1)] for t in texts]
    expected = {(p, k) for p, own in enumerate(grams) for k, g in enumerate(own) if any(g in other and ids[q] < ids[p] for q, other in enumerate(grams))}
    assert got == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 20), st.integers(1, 5))
def test_every_window_lies_in_one_passage(letters, window, shingle):
    shingle = min(shingle, window)
    found = anchors([b"%d" % x for x in letters], _WordHashes(), window, shingle)
    assert len(found) == max(0, len(letters) - window + 1)
    first, last = passages(found, window, shingle)
    assert [k for a, b in zip(first, last) for k in range(a, b + 1)] == list(range(len(found)))
    assert all(b - a < window - shingle + 1 and len(set(found[a : b + 1].tolist())) == 1 for a, b in zip(first, last))
    by_window = {}
    for k, a in enumerate(found.tolist()):
        assert by_window.setdefault(tuple(letters[k : k + window]), a) == a


def test_no_rows(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
