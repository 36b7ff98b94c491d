"""Near-duplicates against all pairs, one by one."""

import random
import re

import pytest

from foliotree.llm import minmax_dedup as near
from foliotree.llm.components import components


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] or doc_id is None else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmno") + str(draw.randint(0, 400))
    text = lambda n: [word() for _ in range(n)]

    def changed(words, n):
        words = list(words)
        for k in draw.sample(range(len(words)), n):
            words[k] = word()
        return words

    rows, base, common = [], text(200), text(60)
    rows += [" ".join(changed(base, draw.randint(0, 9))) for _ in range(150)]  # a large group, similar from 0.4 to 1
    for _ in range(25):
        own = text(draw.randint(5, 120))
        rows += [" ".join(own)] + [" ".join(changed(own, draw.randint(0, max(1, len(own) // 20)))) for _ in range(3)]
    rows += [" ".join(common + text(90)) for _ in range(40)]  # a shared passage links nothing
    rows += ["The sea THE lion and", "the Sea\tthe  lion and", "a b c", "A B C", "a b", "É x", "é x", "w " * 300, "w " * 9, "same words here again now"] + ["dup of it all now here"] * 30
    rows += ["one two three four five six seven eight", "one two three four five six seven nine"]
    draw.shuffle(rows)
    return [(1000 + 7 * i, t) for i, t in enumerate(rows)] + [(1, None), (2, ""), (3, " \n "), (None, "no id but text"), (None, "no ID but text"), (None, None),
                                                          (1000, rows[0]), (5, "with an id and a copy without"), (None, "with an id and a copy without")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_equals_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, label int").repartition(6)
    got = sorted((tuple(r) for r in near.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_blocks_find_what_the_pivots_missed(spark, rows, monkeypatch):
    """With bands that bring nearly everything together and small blocks, queries against blocks do the work."""
    monkeypatch.setattr(near, "BLOCK_NODES", 20)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_duplicates(docs, bands=40, rows=1).collect()), key=str)
    assert got == brute(rows)


def test_kept_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(4, "a b c d e f", 1), (2, "A b c d e f", 2), (9, None, 3)], "doc_id long, text string, n int")
    assert sorted(tuple(r) for r in near.kept_rows(docs).collect()) == [(2, "A b c d e f", 2), (9, None, 3)]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(2))
    sign = near.Signer(bands=640, rows=1)
    for share in (0.3, 0.75, 0.95):
        n = 600
        common = draw.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a, b = (np.concatenate([common, draw.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
        a, b = (near._mixed(x) for x in (a, b))
        true = len(common) / (2 * n - len(common))
        assert abs((sign(a) == sign(b)).mean() - true) < 0.07


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 7), (3, 3), (7, 8), (None, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 3 for k in [3, 7, *range(8, 60)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
