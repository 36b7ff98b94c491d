"""Weak labels, and accuracy on labels that the classifier never sees."""

import os

import numpy as np
import pytest

from foliotree.llm import quality as q

DATA = "/root/testdata/sf0.01"
PROSE = "The end of the story is told by the sea, and nobody heard it. "


def test_votes():
    assert set(q.votes(b"")) == {q.ABSTAIN} == set(q.votes(b" \n"))
    assert set(q.votes((PROSE * 4).encode())) <= {q.CLEAN, q.ABSTAIN} and q.JUNK not in q.votes("That it.".encode())
    by = lambda text: dict(zip(q.LABELLERS, q.votes(text.encode())))
    assert by("the&&& sea### was$$$ not%%%")["symbols"] == q.JUNK
    assert by("BUY!! NOW!! ALL!!")["capitals"] == by("BUY!! NOW!! ALL!!")["shouts"] == q.JUNK
    assert by("a | b | c | d")["pipes"] == q.JUNK
    assert by("word " * 50)["repeats"] == by("word " * 50)["runs"] == q.JUNK


def test_em_finds_the_accuracies():
    draw = np.random.Generator(np.random.PCG64(1))
    truth = (draw.random(20000) > 0.2).astype(int)
    right = [0.95, 0.9, 0.7, 0.85, 0.6, 0.8, 0.9, 0.75, 0.9, 0.85]
    votes = np.stack([np.where(draw.random(20000) < a, truth, 1 - truth) for a in right], 1)
    votes = np.where(draw.random(votes.shape) < 0.3, q.ABSTAIN, votes)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = q.fit_labellers(patterns, counts.astype(float))
    found = np.stack([rates[:, k, k] / rates[:, k, :2].sum(1) for k in (q.JUNK, q.CLEAN)], 1)
    assert abs(prior - 0.2) < 0.02 and np.abs(found.mean(1) - right).max() < 0.05
    assert ((post[index.ravel()] > 0.5) == (truth == 0)).mean() > 0.95


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = q.score(docs, q.fit(docs)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def test_edges(spark):
    rows = [(i, PROSE * 3 + str(i), 0.5) for i in range(40)] + [(50, None, 0.0), (51, "", 0.0), (None, PROSE, 0.0), (52, "X!! Y!! Z!! " * 20, 0.0), (52, "X!! Y!! Z!! " * 20, 0.0),
                                                       (53, "a" * 200000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, junk_score double")
    model = q.fit(docs)
    got = q.score(docs, model).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and kept[50] and kept[51] and kept[None] and not kept[52] and kept[0]
    left = q.kept_rows(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - sum(not r.kept for r in got)
    assert q.score(docs.limit(0), q.fit(docs.limit(0))).count() == 0 and q.kept_rows(docs.limit(0)).count() == 0
    again = {(r.doc_id, r.junk_score) for r in q.score(docs.repartition(3), q.fit(docs.repartition(5))).collect()}
    assert {d for d, _ in again} == set(kept)
