"""A log of upserts: replays, batches out of order, deletions, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from foliotree.sources.log import UpsertLog

SCHEMA = "k int, v int, text string, gone boolean, best int"


def log(spark, path):
    return UpsertLog(spark, str(path), "k", ("v",), gone="gone", largest=("best",))


def rows_of(table):
    return sorted((r.k, r.v, r.text, r.best) for r in table.collect())


def test_newest_row_wins_in_any_order_and_replays_change_nothing(spark, tmp_path):
    a = log(spark, tmp_path)
    with pytest.raises(ValueError):
        a.current()
    first = spark.createDataFrame([(1, 1, "a", False, 5), (2, 1, "b", False, None)], SCHEMA)
    newer = spark.createDataFrame([(1, 3, "c", False, 1)], SCHEMA)
    late = spark.createDataFrame([(1, 2, "late", False, 7), (2, 0, "older", False, 1), (3, 1, "new", None, None)], SCHEMA)
    assert a.commit("10", first) and a.commit("12", newer) and a.commit("11", late)
    assert not a.commit("12", spark.createDataFrame([(1, 99, "replayed otherwise", False, 99)], SCHEMA))
    assert rows_of(a.current()) == [(1, 3, "c", 7), (2, 1, "b", 1), (3, 1, "new", None)]


def test_a_batch_without_a_record_is_not_seen_and_can_be_made_again(spark, tmp_path):
    a = log(spark, tmp_path)
    a.commit("1", spark.createDataFrame([(1, 1, "a", False, 0)], SCHEMA))
    spark.createDataFrame([(1, 5, "half", False, 0)], SCHEMA).write.parquet(f"{tmp_path}/rows/2")
    assert rows_of(a.current()) == [(1, 1, "a", 0)]
    assert a.commit("2", spark.createDataFrame([(1, 6, "whole", False, 0)], SCHEMA))
    assert rows_of(a.current()) == [(1, 6, "whole", 0)]


def test_deleted_stays_deleted_after_compaction(spark, tmp_path):
    a = log(spark, tmp_path)
    a.commit("1", spark.createDataFrame([(1, 1, "a", False, 0), (2, 1, "b", False, 0)], SCHEMA))
    a.commit("2", spark.createDataFrame([(1, 4, None, True, 0)], SCHEMA))
    assert a.compact("3") and not a.compact("3") and a.live() == ["3"]
    assert not a.commit("1", spark.createDataFrame([(1, 9, "again", False, 0)], SCHEMA))
    a.commit("4", spark.createDataFrame([(1, 2, "late", False, 0)], SCHEMA))
    assert rows_of(a.current()) == [(2, 1, "b", 0)]
    a.commit("5", spark.createDataFrame([(1, 5, "back", False, 0)], SCHEMA))
    assert rows_of(a.current()) == [(1, 5, "back", 0), (2, 1, "b", 0)]


def test_random_histories(spark, tmp_path):
    draw = random.Random(6)
    a, all_rows = log(spark, tmp_path), []
    version = {}
    for step in range(12):
        batch = []
        for k in draw.sample(range(8), draw.randint(1, 6)):
            v = draw.choice([x for x in range(100) if (k, x) not in version])
            version[(k, v)] = True
            batch.append((k, v, f"{k}-{v}", draw.random() < 0.2, draw.randint(0, 50)))
        a.commit(f"{step:03d}", spark.createDataFrame(batch, SCHEMA))
        all_rows += batch
        if step % 5 == 4:
            a.compact(f"{step:03d}c")
    newest = {}
    for r in sorted(all_rows, key=lambda r: r[1]):
        newest[r[0]] = r
    expected = sorted((k, v, t, max(x[4] for x in all_rows if x[0] == k)) for k, v, t, gone, _ in newest.values() if not gone)
    assert rows_of(a.current()) == expected and len(a.live()) == 3


def test_new_columns_and_hot_keys(spark, tmp_path):
    a = UpsertLog(spark, str(tmp_path), "k", ("v",))
    a.commit("1", spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("v")))
    a.commit("2", spark.createDataFrame([(2, 1, "x")], "k int, v long, extra string"))
    assert sorted((r.k, r.v, r.extra) for r in a.current().collect()) == [(1, 4999, None), (2, 1, "x")]
    plan = a.current()._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
