from datetime import datetime

from pyspark.sql import functions as F

from foliotree.completer import FunctionCompleter
from foliotree.operators.catalog import get_conversation
from foliotree.plans.chatting import chat_batch, chat_stream

T0 = datetime(2024, 1, 1)

def test_a_batch_of_requests(spark):
    def make_client():
        def client(system, prompt):
            if prompt.startswith("Choose"):
                return '[{"page_start": 1}]'
            if "fail" in prompt:
                raise RuntimeError
            return "answer to " + prompt
        return client

    requests = spark.createDataFrame([
        ("q1", "known", 9, "what?"), ("q2", None, 1, "new " * 20), ("q3", "unknown", 1, "x"), ("q4", None, None, "fail"),
    ], "question_id string, conversation_id string, document_id int, message string")
    conversations = spark.createDataFrame([("known", "K", 1, T0, T0), ("idle", "I", None, T0, T0)],
                                          "conversation_id string, title string, document_id int, created_at timestamp, updated_at timestamp")
    messages = spark.createDataFrame([("m0", "known", "user", "before", None, T0)],
                                     "message_id string, conversation_id string, role string, content string, "
                                     "references array<struct<page:int,reason:string,preview:string>>, created_at timestamp")
    catalog = spark.createDataFrame([(1, True, 1)], "doc_id int, has_tree boolean, page_count int")
    nodes = spark.createDataFrame([(1, [], 0, 0, "t", 1, 1)], "doc_id int, path array<int>, depth int, level int, title string, page_start int, page_end int")
    pages = spark.createDataFrame([(1, 1, "page one", 8)], "doc_id int, page_number int, content string, char_count int")
    done = chat_batch(requests, conversations, messages, catalog, nodes, pages, FunctionCompleter(make_client), now=F.timestamp_seconds(F.lit(1_800_000_000)))

    known = get_conversation(done.conversations, done.messages, "known").collect()
    assert [(r.role, r.content.split("\n")[0]) for r in known] == [("user", "before"), ("user", "what?"), ("assistant", "answer to Document:")]
    assert [tuple(x) for x in known[2].references] == [(1, "", "page one")]
    assert [r.question_id for r in done.rejected.collect()] == ["q3"]
    table = {r.title: r for r in done.conversations.collect()}
    # A failed request is undone as a whole, and listed.
    assert set(table) == {"K", "I", ("new " * 20)[:50] + "..."}
    assert [(r.question_id, r.reason) for r in done.failed.collect()] == [("q4", "no answer")]
    assert table["I"].updated_at == T0 and table["K"].updated_at > datetime(2027, 1, 1)
    assert sorted(r.role for r in done.new_messages.collect()) == ["assistant", "assistant", "user", "user"]


def test_the_end_of_a_streamed_chat(spark):
    requests = spark.createDataFrame([("q1", "known", 9, "what?"), ("q2", None, 1, "new"), ("q3", None, 1, "broken"), ("q4", "known", 1, "under way")],
                                     "question_id string, conversation_id string, document_id int, message string")
    parts = spark.createDataFrame([
        ("q1", 0, "one ", False, False), ("q1", 1, "two", True, False), ("q2", 0, "", True, False), ("q3", 0, "lost", False, False),
        ("q3", 1, None, False, True), ("q4", 1, "end", True, False),
    ], "message_id string, part int, content string, final boolean, expired boolean")
    contexts = spark.createDataFrame([("q1", [(1, "r", "p")])], "question_id string, references array<struct<page:int,reason:string,preview:string>>")
    conversations = spark.createDataFrame([("known", "K", 1, T0, T0)],
                                          "conversation_id string, title string, document_id int, created_at timestamp, updated_at timestamp")
    messages = spark.createDataFrame([], "message_id string, conversation_id string, role string, content string, "
                                         "references array<struct<page:int,reason:string,preview:string>>, created_at timestamp")
    now = F.timestamp_seconds(F.lit(1_800_000_000))
    done = chat_stream(requests, parts, contexts, conversations, messages, now)
    got = {(r.role, r.content): r.references for r in done.messages.collect()}
    assert set(got) == {("user", "what?"), ("assistant", "one two"), ("user", "new"), ("assistant", "")}
    assert [tuple(x) for x in got["assistant", "one two"]] == [(1, "r", "p")]
    assert [(r.question_id, r.reason) for r in done.failed.collect()] == [("q3", "the answer broke off")]
    assert {r.title for r in done.conversations.collect()} == {"K", "new..."}
    # The rest of q4 comes later; what was recorded stays.
    late = parts.unionByName(spark.createDataFrame([("q4", 0, "the ", False, False)], parts.schema))
    again = chat_stream(requests, late, contexts, done.conversations, done.messages, now)
    assert again.messages.count() == 6 and again.conversations.count() == 2
    assert ("assistant", "the end") in {(r.role, r.content) for r in again.messages.collect()}
