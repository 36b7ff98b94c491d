"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from foliotree.functions.durable import stored
from foliotree.llm import phrases
from foliotree.llm.phrases import Bitmap, _WordHashes, collocations, dictionary, frequent_phrases, parse, tokens

SCHEMA = "text string, lang string, phrase string, n int, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_counts(data):
    n, f = Counter(), Counter()
    for text, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang != "" else ""] += len(words)
            for k in range(1, 6):
                f.update((lang or "und" if lang != "" else "", *words[i : i + k]) for i in range(len(words) - k + 1))
    return n, f


def slow_collocations(data, least, top=2000):
    n, f = slow_counts(data)
    found = {}
    for (lang, *words), a in f.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[(lang, *words)] = (a, f[(lang, *words[:k])], f[(lang, *words[k:])], score)
    out = []
    for lang in n:
        rows = []
        for (own, *words), (a, l, r, score) in found.items():
            inside = any(o == own and len(x) > len(words) and b[0] >= a and any(x[i : i + len(words)] == words for i in range(len(x)))
                         for (o, *x), b in found.items())
            if own == lang and not inside:
                rows.append((-score, -a, " ".join(words).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def made_up(seed, texts=150):
    draw = random.Random(seed)
    words = ["Red", "red", "tea", "é", "Ünter", "ünter", "a", "b", "c", "of the", "na\xa0me", "new york city", "x.y"]
    blanks = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "!?", ";\r\n", "\x0b", "\x0c ", ":"]
    data = [(None, "en"), ("", None), (" \t. , ", "en"), ("one", ""), ("...", "de"), ("A,", "zz"), ("w " * 3000, "rep"), ("a b c d e " * 100, "rep")]
    for _ in range(texts):
        text = "".join(draw.choice(words) + draw.choice(blanks) for _ in range(draw.randint(0, 90)))
        data += [(text, draw.choice(["en", "de", None, "und"]))] * draw.choice([1, 1, 1, 4])
    return data


@pytest.mark.parametrize("least,modulus", [(3, 4), (20, 32), (1, 1)])
def test_against_a_plain_count(spark, rows, least, modulus):
    data = made_up(least, 150 if least > 1 else 12)
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA).repartition(5)
    got = rows(collocations(docs, least=least, modulus=modulus))
    assert got == slow_collocations(data, least) and len(got) > 20


def test_a_full_bitmap_only_costs_time(spark, rows):
    data = made_up(11)
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA)
    assert rows(collocations(docs, least=5, bits=64)) == slow_collocations(data, 5)


def test_top_of_several_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "RANK_ROWS", 7)
    data = made_up(12)
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA)
    assert rows(collocations(docs, least=3, top=5)) == slow_collocations(data, 3, 5)


def test_counts_of_the_dictionary(spark):
    """Overlaps count once, chunk by chunk; several buffers, and words that fall out of the cache."""
    data = made_up(13)
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA).repartition(3)
    chunks = stored(dictionary(docs, modulus=3))
    n, f = slow_counts(data)
    got = {(r.lang, *r.phrase.split(" ")): r.f for r in frequent_phrases(chunks, 2).collect()}
    expected = {k: v for k, v in f.items() if v >= 2}
    inside = {(k[0], w) for k in expected if len(k) > 2 for w in k[1:]}
    assert got == {k: v for k, v in expected.items() if len(k) > 2 or k in inside}
    assert chunks.count() == chunks.select("lang", "chunk").distinct().count() < chunks.groupBy().sum("n").first()[0]


def test_the_last_pass_makes_one_row_a_phrase(spark, monkeypatch):
    """Not one for every task that meets it."""
    draw = random.Random(5)
    often = [" ".join(draw.choice("abcdefgh") + str(k) for k in range(3)) for _ in range(12)]
    data = [(" ".join(draw.choice([draw.choice(often), f"x{draw.random()}"]) for _ in range(60)), "en") for _ in range(300)]
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = stored(dictionary(docs, modulus=8))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made, passes = phrases._texts, []
    monkeypatch.setattr(phrases, "_texts", lambda *a: passes.append(stored(made(*a))) or passes[-1])
    monkeypatch.setattr(phrases, "_exact", None)
    found = frequent_phrases(chunks, 20)
    places = chunks.select("place").distinct().count()
    assert places > 2 and found.where("words > 1").count() > 12
    assert passes[0].count() <= 1.2 * found.count()


@pytest.mark.parametrize("wrong", ["check + 1", "if(phrase = 'a b', null, check)"])
def test_phrases_of_one_hash_are_counted_by_their_words(spark, rows, monkeypatch, wrong):
    """As if the words found were not all that the hash counted."""
    data = made_up(14)
    docs = spark.createDataFrame([(t, x, "no", 1, 2) for t, x in data], SCHEMA)
    made, exact, passes = phrases._texts, phrases._exact, []
    monkeypatch.setattr(phrases, "_texts", lambda *a: made(*a).selectExpr("h", f"{wrong} AS check", "lang", "phrase", "words"))
    monkeypatch.setattr(phrases, "_exact", lambda *a: passes.append(1) or exact(*a))
    assert rows(collocations(docs, least=4)) == slow_collocations(data, 4) and passes == [1]


def test_folded_numbers_are_the_same_modulo_the_prime():
    x = np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    folded = phrases._folded(x)
    assert (folded % np.uint64(phrases.CHECKS) == x % np.uint64(phrases.CHECKS)).all() and folded.max() < 1 << 34


def test_a_word_that_is_named_like_a_language(spark):
    """Their hashes differ, as each language has its own hashes of words."""
    docs = spark.createDataFrame([("de de x", "en", "no", 1, 2), ("en en x", "de", "no", 1, 2)], SCHEMA)
    counts = phrases._frequent(stored(dictionary(docs)), Bitmap.empty(), 1, 1, 1)
    assert sorted(r.n for r in counts.collect()) == [1, 1, 2, 2]


def test_texts_cut_together_are_cut_like_each_alone():
    draw = random.Random(6)
    hashed = _WordHashes()
    texts = [tokens(" ".join(draw.choice(["a", "b", "C,", "d.\n", "e\t"]) for _ in range(draw.choice([0, 1, 30]))).encode()) for _ in range(60)]
    hashes = [np.fromiter(map(hashed.__getitem__, x), np.uint64, len(x)) for x in texts]
    padded = [t for x in texts for t in x + [phrases.PIECE_END] * 4]
    together = phrases._chunks(padded, np.concatenate([np.append(h, np.zeros(4, np.uint64)) for h in hashes]), [len(x) for x in texts], 3)
    assert together == [parse(x, h, 3) for x, h in zip(texts, hashes)] and max(map(len, together)) > 5
    assert phrases._chunks([], np.zeros(0, np.uint64), [], 3) == []


def test_parse_is_prefix_free_and_whole():
    draw = random.Random(3)
    hashed = _WordHashes()
    seen = set()
    for _ in range(300):
        found = tokens(" ".join(draw.choice(["a", "b", "c,", "d."]) for _ in range(draw.randint(0, 60))).encode())
        hashes = np.fromiter(map(hashed.__getitem__, found), np.uint64, len(found))
        chunks = [c.split(b" ") for c in parse(found, hashes, 5)]
        assert sum((c[:-4] for c in chunks), []) == found
        for c, d in zip(chunks, chunks[1:]):
            assert c[-4:] == d[:4]
        seen |= {tuple(c) for c in chunks}
    for c in seen:
        assert not any(d != c and d[: len(c)] == c for d in seen)


def test_big_products(spark):
    found = spark.createDataFrame([("x", "p q", 2, 10**9), ("x", "p", 1, 10**9 + 7), ("x", "q", 1, 10**10 + 9)], "lang string, phrase string, words int, f long")
    n = 10**15 + 123_456_789
    totals = spark.createDataFrame([("x", n)], "lang string, n long")
    row = phrases.scored(found, totals).first()
    assert row.score == 1000 * 10**9 * n // ((10**9 + 7) * (10**10 + 9))


def test_bitmap_has_what_it_was_given(spark):
    values = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    keys = spark.createDataFrame([(int(v),) for v in values], "h long")
    bitmap = Bitmap.empty(1 << 16).with_keys(keys)
    assert bitmap.has(values.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert bitmap.has(other).mean() < 0.2


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
