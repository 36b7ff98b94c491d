"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from foliotree.llm import periodic_runs
from foliotree.llm.periodic_runs import SuffixTree, collapsed, digests, find_runs, planted_period, tree_runs, word_runs


def slow_runs(words, least=6, periods=4):
    """Every stretch of period q that can't be made longer, for every q, without those that have a smaller period."""
    n, found = len(words), {}
    for q in range(1, n):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(least, periods * q):
                found.setdefault((at, length), q)  # the smallest period is met first
            at = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        original = list(words)
        for i in range(a, n):
            words[i] = original[a + (i - a) % p]
    runs = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(kept)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6), st.integers(0, 9))
def test_all_runs(letters, period, times):
    """Random words, and random words with a repeated part; every threshold, not only that of the query."""
    words = letters[:20] + letters[:period] * times + letters[20:]
    numbers = [x + 1 for x in words]
    assert tree_runs(numbers, 2, 2) == slow_runs(words, 2, 2)
    assert word_runs([b"%d" % x for x in words]) == slow_runs(words)


@pytest.mark.parametrize("words", [[], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 3] * 40 + [1, 2], [1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 2] * 6])
def test_regular_words(words):
    assert word_runs([b"%d" % x for x in words]) == slow_runs(words)


def test_tree_has_every_suffix_in_order():
    draw = random.Random(5)
    for _ in range(200):
        text = [draw.randint(1, 3) for _ in range(draw.randint(1, 40))]
        places, depths = SuffixTree(text).tour()
        suffixes = sorted(range(len(text) + 1), key=lambda i: text[i:])
        assert np.argsort(places).tolist() == suffixes
        for a, b, depth in zip(suffixes, suffixes[1:], depths.tolist()[1:]):
            same = 0
            while max(a, b) + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert same == depth


def test_rows_and_edges(spark, rows):
    draw = random.Random(8)
    texts = [None, "", " \t\n ", "a", "x " * 7, "A a " * 5, "é\xa0b é\xa0b " * 4, "na\x0bna\x0cna na\rna na", "w " * 30_000]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 80))) for _ in range(120)]
    texts += [" ".join(draw.choice(["der", "die", "das"]) + draw.choice("x .") for _ in range(300)) for _ in range(10)]
    data = [(i, t, i, 0) for i, t in enumerate(texts)] + [(3, "a", 7, 0), (3, "a", 7, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_runs int, runs long").repartition(4)
    found = digests(find_runs(docs, rewrite=planted_period))
    brief = [d for d in data if not (d[1] or "").startswith("w w")]
    assert rows(found.where("doc_id <> 8")) == sorted((slow_row(d[0], d[1]) for d in brief), key=repr)
    assert any(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in brief)
    long = found.where("doc_id = 8").first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"w").hexdigest()


def test_null_ids_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b " * 6), ("k", "a b " * 6)], "name string, body string")
    found = find_runs(docs, "name", "body", rewrite=lambda i, w: w).collect()
    assert {r.doc_id for r in found} == {None, "k"} and all([tuple(x) for x in r.runs] == [(0, 12, 2)] and r.collapsed == "a b" for r in found)
    assert planted_period(None, [b"a"] * 20) == [b"a"] * 20
    assert digests(find_runs(docs.limit(0), "name", "body")).collect() == []


def test_what_several_runs_drop_goes_once():
    words = b"a a a a a a b a a a a a a b a a a a a a b a a a a a a b".split()
    runs = slow_runs(words)
    assert len(runs) == 5
    assert collapsed(words, runs) == b"a b"


def test_a_stretch_that_repeats_less_has_no_tree():
    words = [b"%d" % (k % 500) for k in range(1000)] + [b"x", b"y"] * 5
    assert periodic_runs.stretches(np.array([int(w) if w.isdigit() else 500 + (w == b"y") for w in words])) == [(1000, 1010)]
    assert word_runs(words) == [(1000, 10, 2)]
