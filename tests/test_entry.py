"""Every registered query against its SQL at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from foliotree.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

# Queries without SQL; see the README.
ROWS_ONLY: set[str] = set()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["question_id", "conversation_id", "doc_id", "n_pages", "context"]
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    kinds = dict(zip(names, (str(d[1]) for d in expected.description)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    order = [names.index(c) for c in columns]
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(tuple(r[i] for i in order) for r in expected.fetchall())
