"""Appends, tombstones and compaction of stored tables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliotree.operators import catalog as c
from foliotree.sources.versions import VersionedTable, changed_tables, delete_conversations, delete_documents

T0 = datetime(2024, 3, 30)
MESSAGES = "message_id string, conversation_id string, content string, created_at timestamp"


def messages(spark, rows):
    return spark.createDataFrame([(f"m{i}", f"c{k:03d}", f"text {i}", T0 + timedelta(minutes=i)) for i, k in rows], MESSAGES)


def table(spark, path):
    return VersionedTable(spark, str(path), "conversation_id", "message_id", ("created_at",), ("conversation_id", "created_at"), files=6)


def ids(df):
    return sorted(r.message_id for r in df.collect())


def files_of(t):
    return sorted(r.file for r in t.manifest().where("kind = 'file' AND rows > 0").collect())


def test_append_once_by_batch_and_by_id(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(i, i % 7) for i in range(100)]))
    new = messages(spark, [(i, i % 7) for i in range(90, 120)] + [(119, 119 % 7)])
    assert t.append(new, "b1")
    assert ids(t.read()) == sorted(f"m{i}" for i in range(120))
    assert not t.append(messages(spark, [(500, 1)]), "b1")
    assert t.append(new, "b2") and t.read().count() == 120 and t.latest() == 2
    assert t.read(0).count() == 100
    nameless = messages(spark, [(700, 1), (701, 2)]).withColumn("message_id", F.lit(None).cast("string"))
    t.append(nameless, "b3")
    assert t.read().count() == 122


def test_append_opens_only_files_that_may_hold_a_repeat(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(i, i % 50) for i in range(200)]))
    for day in range(1, 4):
        t.append(messages(spark, [(1000 * day + i, i % 50) for i in range(200)]), f"day{day}")
    opened = []
    scan = t._scan
    monkeypatch.setattr(t, "_scan", lambda files: opened.append(files) or scan(files))
    t.append(messages(spark, [(3100 + i, i % 50) for i in range(200)]), "day3, late")
    assert opened[0] and all("/files/00000003/" in f for f in opened[0])
    assert t.read().count() == 200 * 4 + 100


def test_a_new_row_without_a_place_is_sought_everywhere(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(1, 1), (2, 2)]))
    t.append(messages(spark, [(1, 1)]).withColumn("created_at", F.lit(None).cast("timestamp")).unionByName(messages(spark, [(900, 3)])), "b")
    assert ids(t.read()) == ["m1", "m2", "m900"]


def test_tombstones_hide_and_compaction_rewrites_touched_files_only(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(i, i // 10) for i in range(1000)]))
    before = files_of(t)
    assert len(before) > 2
    gone = spark.createDataFrame([("c003",), ("c003",), ("c001",), (None,), ("nope",)], "conversation_id string")
    assert t.delete(gone, "d1") and not t.delete(gone, "d1")
    assert files_of(t) == before
    assert ids(t.read()) == sorted(f"m{i}" for i in range(1000) if i // 10 not in (1, 3))
    size = {f: os.stat(f.removeprefix("file:").replace("//", "/")).st_mtime_ns for f in before}
    holds = {r.file for r in spark.read.parquet(*before).where("conversation_id IN ('c001', 'c003')").select(F.col("_metadata.file_path").alias("file")).collect()}
    replaced = t.compact()
    assert set(replaced) == holds and 0 < len(replaced) < len(before)
    after = files_of(t)
    assert set(before) - set(replaced) <= set(after)
    assert all(os.stat(f.removeprefix("file:").replace("//", "/")).st_mtime_ns == size[f] for f in before)
    assert ids(t.read()) == sorted(f"m{i}" for i in range(1000) if i // 10 not in (1, 3))
    assert t.compact() == [] and t.manifest().where("kind = 'gone'").isEmpty()
    assert not t.delete(gone, "d1")  # commits are remembered


def test_a_deleted_key_may_come_back(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(1, 1), (2, 2)]))
    t.delete(spark.createDataFrame([("c001",)], "conversation_id string"), "d")
    t.append(messages(spark, [(1, 1), (3, 1)]), "a")
    assert ids(t.read()) == ["m1", "m2", "m3"]
    t.compact()
    assert ids(t.read()) == ["m1", "m2", "m3"]


def test_empty_tables_and_a_second_writer(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    with pytest.raises(ValueError):
        t.read()
    t.create(messages(spark, []).limit(0))
    assert t.read().count() == 0 and t.read().columns == ["message_id", "conversation_id", "content", "created_at"]
    t.append(messages(spark, []).limit(0), "nothing")
    t.delete(spark.createDataFrame([], "conversation_id string"), "none")
    assert t.read().count() == 0 and t.compact() == []
    with pytest.raises(Exception):
        t._put(0, t.manifest())


def test_no_whole_table_is_moved(spark, tmp_path):
    t = table(spark, tmp_path / "m")
    t.create(messages(spark, [(i, i % 9) for i in range(300)]))
    t.delete(spark.createDataFrame([("c001",)], "conversation_id string"), "d")
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_documents_go_like_in_plain_tables(spark, tmp_path):
    plain = {
        "catalog": spark.createDataFrame([(i, f"n{i}") for i in range(20)], "doc_id int, name string"),
        "doc_pages": spark.createDataFrame([(i, p, "x") for i in range(20) for p in range(3)], "doc_id int, page_number int, content string"),
        "conversations": spark.createDataFrame([(f"c{k:03d}", k % 25 if k % 6 else None) for k in range(60)], "conversation_id string, document_id int"),
        "messages": messages(spark, [(i, i % 60) for i in range(300)]),
    }
    gone = spark.createDataFrame([(i,) for i in (0, 3, 7, 99)], "doc_id int")
    kinds = changed_tables(spark, str(tmp_path))
    tables = {name: kinds[name] for name in plain}
    for name, df in plain.items():
        tables[name].create(df)
    delete_documents(tables, gone, "run 1")
    delete_documents(tables, gone, "run 1")
    expected = c.delete_documents(plain, gone)
    same = lambda: all(sorted(map(repr, tables[n].read().collect())) == sorted(map(repr, expected[n].select(*plain[n].columns).collect())) for n in plain)
    assert same()
    for t in tables.values():
        t.compact()
    assert same()
    delete_conversations({n: tables[n] for n in ("messages", "conversations")}, spark.createDataFrame([("c001",)], "conversation_id string"), "run 2")
    assert tables["conversations"].read().where("conversation_id = 'c001'").isEmpty() and tables["messages"].read().where("conversation_id = 'c001'").isEmpty()
