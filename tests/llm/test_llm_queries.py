"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from foliotree.functions.durable import stored
from foliotree.llm import chunk_dedup, minmax_dedup, mixing, quality
from foliotree.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLE[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*names).collect())
    assert got == Counter(expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_row(spark, name):
    df = QUERIES[name](spark, DATA)
    key = "page_id" if name == "op3_html" else "doc_id"
    source = "pages" if name == "op3_html" else "documents"
    given = Counter(r[0] for r in spark.read.parquet(f"{DATA}/{source}.parquet").select(key).collect())
    got = Counter(r[0] for r in df.select(key).collect())
    assert set(got) == set(given) and (name == "op10_packing" or got == given)


def test_pipeline(spark):
    """Each stage keeps what its operator decides on the stage's own input, and the last one packs every token of it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]

    clean = stored(steps["quality"](spark, docs, DATA))
    ids = {r.doc_id for r in quality.score(docs, quality.fit(docs)).where("kept").collect()}
    assert clean.columns == columns and rows(clean) == rows(docs.where(docs.doc_id.isin(list(ids))))
    assert 0 < len(ids) < docs.count()

    single = stored(steps["exact_dedup"](spark, clean, DATA))
    first = {}
    for r in clean.orderBy("doc_id").collect():
        first.setdefault(" ".join(r.text.split()), r.doc_id)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(first.values())

    apart = stored(steps["near_dedup"](spark, single, DATA))
    keep = {r.doc_id for r in minmax_dedup.near_duplicates(single).where("kept").collect()}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == keep and len(keep) < single.count()

    mixed = stored(steps["mixing"](spark, apart, DATA))
    taken = {r.doc_id: r.taken for r in mixing.mix(apart, mixing.cyclic_weights).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert mixed.columns == columns and words == Counter({d: t for d, t in taken.items() if t})

    packed = steps["packing"](spark, mixed, DATA).collect()
    per_doc = Counter()
    for r in packed:
        per_doc[r.doc_id] += r.length
    assert set(per_doc) == set(words)
    run = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in run if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)
