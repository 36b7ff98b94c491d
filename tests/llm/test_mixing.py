"""Mixing against a plain loop."""

import hashlib
import random
from collections import defaultdict

from foliotree.llm import mixing


def water(sizes, weights, budget, epochs):
    """Targets by bisection of the level."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, epochs * s) for s, w in zip(sizes, weights)) < budget else (low, level)
    return [min(w * low, epochs * s) for s, w in zip(sizes, weights)]


def test_targets_and_takes(spark):
    draw = random.Random(3)
    data = [(i if i % 50 else None, draw.choice(["a"] * 8 + ["b", "c", "d", None]), " ".join(["w"] * draw.randint(0, 40)) if i % 9 else None, 5, "x")
            for i in range(700)] + [(7, "e", "one\ttwo x  three ", 1, "y")] * 3
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, size int, target string")
    rows = mixing.mix(docs, mixing.cyclic_weights).collect()
    assert len(rows) == len(data)
    size_of = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    expected = defaultdict(int)
    for _, s, t, *_ in data:
        expected[s] += size_of(t)
    names = sorted((s for s in expected if s is not None)) + [None]
    weights = [(3, 1, 2)[i % 3] for i in range(len(names))]
    targets = dict(zip(names, water([expected[s] for s in names], weights, 1.5 * sum(expected.values()), 2)))
    got = defaultdict(list)
    by_id = {(d, s, size_of(t)) for d, s, t, *_ in data}
    source_of = defaultdict(set)
    for d, s, n in by_id:
        source_of[d, n].add(s)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        got[r.source_size, round(r.target, 3)].append(r)
    for s in names:
        own = got[expected[s], round(round(targets[s], 6), 3)]
        assert own and abs(sum(r.taken for r in own) - targets[s] * len(own) / len([1 for x in data if x[1] == s])) <= 1
    again = mixing.mix(docs.repartition(7), mixing.cyclic_weights).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_order_is_the_seeded_hash(spark):
    docs = spark.createDataFrame([(i, "a", "w " * 10) for i in range(40)], "doc_id long, source string, text string")
    even = lambda s: s.withColumn("weight", mixing.F.lit(1.0))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, even, budget_factor=0.53).collect()}
    order = sorted(range(40), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
    assert [taken[i] for i in order] == [10] * 21 + [2] + [0] * 18
    assert sum(r.taken for r in mixing.mix(docs, even, seed="other", budget_factor=0.53).collect()) == 212


def test_copies_follow_the_decisions(spark):
    docs = spark.createDataFrame([(1, "a", " x y  z\nq ", "k"), (2, "b", None, "k"), (3, "b", "m n o p q r", "k")], "doc_id long, source string, text string, taken string")
    mixed = mixing.mix(docs, mixing.cyclic_weights, keep=True)
    facts = {r.doc_id: (r["__mix"].taken, r["__mix"].size) for r in mixed.collect()}
    out = mixing.copies(mixed)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {d: t for d, (t, n) in facts.items() if t}
    assert sum(words.values()) == 15


def test_no_rows_no_words_and_zero_weights(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.size, r.taken) for r in mixing.mix(docs, mixing.cyclic_weights).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix(docs.limit(0), mixing.cyclic_weights).count() == 0
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y z")], "doc_id long, source string, text string")
    only = lambda s: s.withColumn("weight", mixing.F.when(mixing.F.col("source") == "a", 1.0))
    assert {r.doc_id: r.taken for r in mixing.mix(docs, only).collect()} == {1: 2, 2: 0}


def test_ties_meet_their_target(spark):
    """Null and shared ids, equal sizes, equal texts: every source takes exactly its rounded target."""
    data = [(None, "a", "w w w w w w w w w w") for _ in range(500)] + [(None, "a", f"x{i} w w w") for i in range(300)]
    data += [(7, "b", f"v{i % 3} w w w w") for i in range(400)] + [(i % 5, None, "u u u") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(5)
    for factor in (0.37, 0.8, 1.5, 1.93):
        rows = mixing.mix(docs, mixing.cyclic_weights, budget_factor=factor).collect()
        assert len(rows) == len(data)
        by_source = defaultdict(list)
        for r in rows:
            by_source[r.source_size, r.target].append(r.taken)
            assert 0 <= r.taken <= 2 * r.size
        assert len(by_source) == 3
        for (_, target), taken in by_source.items():
            assert sum(taken) == int(target + 0.5)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x y z", 5, "k", 2)], "doc_id long, source string, text string, __mix int, __words string, __doc int")
    out = mixing.copies(mixing.mix(docs, mixing.cyclic_weights, keep=True))
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "x y", 5, "k", 2)] or sum(len(r.text.split()) for r in out.collect()) == 5
