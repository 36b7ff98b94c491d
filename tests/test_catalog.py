from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliotree.operators import catalog as c

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(d, f"n{d}.txt", s, s == "ready", e, T0 + timedelta(days=d), 0)
            for d, s, e in [(1, "ready", None), (2, "error", "old"), (3, "pending", None), (4, "ready", None)]]
    convs = [("a", "A", 1, T0, T0 + timedelta(hours=3)), ("b", "B", 1, T0, T0 + timedelta(hours=5)),
             ("c", "C", 4, T0, T0 + timedelta(hours=4)), ("d", "D", None, T0, T0 + timedelta(hours=1))]
    messages = [(f"{k}{i}", k, "user" if i % 2 == 0 else "assistant", f"t{i}", None, T0 + timedelta(minutes=i)) for k in "abc" for i in range(3)]
    return {
        "catalog": spark.createDataFrame(docs, "doc_id int, name string, index_status string, has_tree boolean, error_message string, created_at timestamp, page_count int"),
        "conversations": spark.createDataFrame(convs, "conversation_id string, title string, document_id int, created_at timestamp, updated_at timestamp"),
        "messages": spark.createDataFrame(messages, "message_id string, conversation_id string, role string, content string, "
                                          "references array<struct<page:int,reason:string,preview:string>>, created_at timestamp"),
        "doc_pages": spark.createDataFrame([(1, 1), (1, 2), (4, 1)], "doc_id int, page_number int"),
    }


def test_listing_and_lookup(spark, tables):
    listed = c.list_documents(tables["catalog"])
    assert [r.doc_id for r in listed.collect()] == [4, 3, 2, 1] and "error_message" not in listed.columns
    assert [r.name for r in c.get_document(tables["catalog"], 2).collect()] == ["n2.txt"]
    assert c.get_document(tables["catalog"], 99).count() == 0
    assert tuple(c.index_status(tables["catalog"], 2).first()) == (2, "error", "old")
    assert sorted(r.doc_id for r in c.ready_documents(tables["catalog"]).collect()) == [1, 4]


def test_conversations_newest_first_with_messages_in_order(tables):
    rows = c.list_conversations(tables["conversations"], tables["messages"]).collect()
    assert [(r.conversation_id, r.message_id) for r in rows] == [
        *[("b", f"b{i}") for i in range(3)], *[("c", f"c{i}") for i in range(3)], *[("a", f"a{i}") for i in range(3)], ("d", None),
    ]
    one = c.list_conversations(tables["conversations"], tables["messages"], 4).collect()
    assert {r.conversation_id for r in one} == {"c"} and len(one) == 3
    assert [r.message_id for r in c.get_conversation(tables["conversations"], tables["messages"], "a").collect()] == ["a0", "a1", "a2"]
    assert [r.message_id for r in c.get_conversation(tables["conversations"], tables["messages"], "d").collect()] == [None]
    assert c.get_conversation(tables["conversations"], tables["messages"], "zz").count() == 0


def test_titles(spark):
    df = spark.createDataFrame([("x" * 50,), ("x" * 51,), ("é😀" * 26,)], "m string")
    got = [tuple(r) for r in df.select(c.conversation_title(F.col("m")), c.conversation_title(F.col("m"), "stream")).collect()]
    assert got == [("x" * 50, "x" * 50 + "..."), ("x" * 50 + "...",) * 2, ("é😀" * 25 + "...",) * 2]


def test_get_or_create(spark, tables):
    requests = spark.createDataFrame([("q1", "a", 4, "hello"), ("q2", None, 4, "hi"), ("q3", "zz", 1, "x"), ("q4", "", None, "y")],
                                     "question_id string, conversation_id string, document_id int, message string")
    resolved, created, rejected = c.get_or_create(requests, tables["conversations"])
    got = {r.question_id: (r.conversation_id, r.document_id) for r in resolved.collect()}
    assert got["q1"] == ("a", 1) and got["q2"][1] == 4 and got["q4"][1] is None and set(got) == {"q1", "q2", "q4"}
    assert {(r.conversation_id, r.title) for r in created.collect()} == {(got["q2"][0], "hi"), (got["q4"][0], "y")}
    assert [tuple(r) for r in rejected.collect()] == [("q3", "zz", "conversation not found")]


def test_append_moves_only_touched_conversations(spark, tables):
    new = spark.createDataFrame([("n1", "a", "user", "x", T0 + timedelta(days=9)), ("n2", "a", "assistant", "y", T0 + timedelta(days=10))],
                                "message_id string, conversation_id string, role string, content string, created_at timestamp")
    messages, conversations = c.append_messages(tables["messages"], tables["conversations"], new)
    assert messages.count() == 11
    at = {r.conversation_id: r.updated_at for r in conversations.collect()}
    assert at["a"] == T0 + timedelta(days=10) and at["b"] == T0 + timedelta(hours=5)


def test_older_and_replayed_messages_move_nothing_back(spark, tables):
    schema = "message_id string, conversation_id string, role string, content string, created_at timestamp"
    new = spark.createDataFrame([("old", "a", "user", "x", T0 - timedelta(days=9)), ("b0", "b", "user", "t0", T0)], schema)
    messages, conversations = c.append_messages(tables["messages"], tables["conversations"], new)
    assert messages.count() == 10
    at = {r.conversation_id: r.updated_at for r in conversations.collect()}
    assert at["a"] == T0 + timedelta(hours=3) and at["b"] == T0 + timedelta(hours=5)
    again, same = c.append_messages(messages, conversations, new)
    assert again.count() == 10 and sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, conversations.collect()), key=repr)


def test_deleting_a_conversation(spark, tables):
    ids = spark.createDataFrame([("a",), ("a",), ("nope",)], "conversation_id string")
    conversations, messages = c.delete_conversations(tables["conversations"], tables["messages"], ids)
    assert sorted(r.conversation_id for r in conversations.collect()) == ["b", "c", "d"]
    assert {r.conversation_id for r in messages.collect()} == {"b", "c"} and messages.count() == 6


def test_deleting_a_document_leaves_no_orphans(spark, tables):
    kept = c.delete_documents(tables, spark.createDataFrame([(1,)], "doc_id int"))
    assert sorted(r.doc_id for r in kept["catalog"].collect()) == [2, 3, 4]
    assert sorted(r.conversation_id for r in kept["conversations"].collect()) == ["c", "d"]
    assert {r.conversation_id for r in kept["messages"].collect()} == {"c"} and kept["messages"].count() == 3
    assert [r.doc_id for r in kept["doc_pages"].collect()] == [4]


def test_status_changes(spark, tables):
    ids = spark.createDataFrame([(2,), (4,), (99,)], "doc_id int")
    pending = c.mark_reindex(tables["catalog"], ids)
    assert {r.doc_id: r.index_status for r in pending.collect()} == {1: "ready", 2: "pending", 3: "pending", 4: "pending"}
    indexing = c.mark_indexing(pending, ids)
    results = spark.createDataFrame([(2, True, 5, None), (4, False, None, "bad"), (99, True, 1, None)],
                                    "doc_id int, success boolean, page_count int, error_message string")
    after = {r.doc_id: (r.index_status, r.page_count, r.has_tree, r.error_message) for r in c.apply_status(indexing, results).collect()}
    # An old error message outlives success; a failure keeps the tree.
    assert after == {1: ("ready", 0, True, None), 2: ("ready", 5, True, "old"), 3: ("pending", 0, False, None), 4: ("error", 0, True, "bad")}


def test_changes_move_updated_at(spark):
    catalog = spark.createDataFrame([(1, "ready", True, 1, None, T0), (2, "ready", True, 1, None, T0)],
                                    "doc_id int, index_status string, has_tree boolean, page_count int, error_message string, updated_at timestamp")
    now = F.lit(T0 + timedelta(days=1)).cast("timestamp")
    marked = c.mark_reindex(catalog, spark.createDataFrame([(1,)], "doc_id int"), now)
    assert {r.doc_id: r.updated_at for r in marked.collect()} == {1: T0 + timedelta(days=1), 2: T0}
    results = spark.createDataFrame([(2, True, 3, None)], "doc_id int, success boolean, page_count int, error_message string")
    assert {r.doc_id: r.updated_at > T0 for r in c.apply_status(catalog, results).collect()} == {1: False, 2: True}
