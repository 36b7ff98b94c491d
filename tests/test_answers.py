from pyspark.sql import functions as F

from foliotree.completer import FunctionCompleter, NullCompleter
from foliotree.operators import answers as a
from foliotree.plans import answering


def retrieved(spark):
    return spark.createDataFrame([
        ("q", 2, 1, "one", "b"), ("q", 1, 4, "y" * 2000, "a"), ("q", 1, 5, "five", None), ("p", 1, 1, "z", ""),
    ], "question_id string, rank int, page int, content string, reason string")


def test_context_and_references_follow_the_ranks(spark):
    got = {r.question_id: r for r in a.assemble(retrieved(spark)).collect()}
    assert got["q"].context == "\n\n[Page 4]\n" + "y" * 1500 + "\n\n[Page 5]\nfive\n\n[Page 1]\none"
    assert [tuple(x) for x in got["q"].references] == [(4, "a", "y" * 200), (5, None, "five"), (1, "b", "one")]
    assert a.build_context(retrieved(spark)).where("question_id = 'p'").first().context == "\n\n[Page 1]\nz"
    assert len(a.build_references(retrieved(spark), 3).where("question_id = 'q'").first().references[0].preview) == 3


def tables(spark):
    questions = spark.createDataFrame([("q1", "c1", "m1"), ("q2", "c2", "m2"), ("q3", "c3", "m3"), ("q4", "gone", "m4"), ("q5", "c4", "m5")],
                                      "question_id string, conversation_id string, message string")
    conversations = spark.createDataFrame([("c1", 1), ("c2", None), ("c3", 2), ("c4", 9)], "conversation_id string, document_id int")
    catalog = spark.createDataFrame([(1, True, 2), (2, False, 1)], "doc_id int, has_tree boolean, page_count int")
    pages = spark.createDataFrame([(1, 1, "p1", 2), (1, 2, "p2", 2), (2, 1, "x", 1)], "doc_id int, page_number int, content string, char_count int")
    nodes = spark.createDataFrame([(1, [], 0, 0, "t", 1, 2)], "doc_id int, path array<int>, depth int, level int, title string, page_start int, page_end int")
    return questions, conversations, catalog, nodes, pages


def test_documents_count_only_with_a_tree(spark):
    questions, conversations, catalog, _, _ = tables(spark)
    got = {r.question_id: r.doc_id for r in a.resolve_documents(questions, conversations, catalog).collect()}
    assert got == {"q1": 1, "q2": None, "q3": None, "q4": None, "q5": None}


def test_answers_with_a_model(spark):
    def make_client():
        def client(system, prompt):
            if prompt.startswith("Choose"):
                return '[{"page_start": 2, "reason": "fits"}]'
            return f"{len(system)}|{prompt}"
        return client

    questions, conversations, catalog, nodes, pages = tables(spark)
    got = {r.question_id: r for r in answering.answer_questions(
        questions, conversations, catalog, nodes, pages, FunctionCompleter(make_client), style="stream").collect()}
    system = len(a.ANSWER_SYSTEM["stream"])
    assert got["q1"].answer == f"{system}|Document:\n\n[Page 2]\np2\n\nQuestion: m1\n\n{a.ANSWER_CLOSE['stream']}"
    assert [tuple(x) for x in got["q1"].references] == [(2, "fits", "p2")]
    assert got["q3"].answer == f"{system}|Question: m3" and got["q3"].references is None
    messages = answering.answer_messages(spark.createDataFrame(list(got.values())))
    assert messages.count() == 5 and {r.role for r in messages.collect()} == {"assistant"}


def test_context_without_a_model_is_the_same_by_document_and_by_question(spark):
    questions, conversations, catalog, _, pages = tables(spark)
    quick = answering.question_context(questions, conversations, catalog, None, pages, NullCompleter())
    from foliotree.operators.retrieval import fallback_pages
    resolved = a.resolve_documents(questions, conversations, catalog)
    slow = a.attach_context(resolved, a.assemble(fallback_pages(resolved.where("doc_id IS NOT NULL"), pages)))
    columns = ["question_id", "doc_id", "context", "references"]
    assert sorted(map(repr, quick.select(columns).collect())) == sorted(map(repr, slow.select(columns).collect()))


def chunks(spark):
    texts = ["Hel", "lo ", "<think>", "  ", "w</think>x", "!"]
    return spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "message_id string, seq int, chunk string")


def test_chunk_filter_and_fold(spark):
    kept = a.filter_chunks(chunks(spark))
    assert [r.chunk for r in kept.orderBy("seq").collect()] == ["Hel", "lo ", "!"]
    shuffled = kept.unionByName(kept).orderBy(F.desc("seq"))
    assert [tuple(r) for r in a.fold_chunks(shuffled).collect()] == [("m", "Hello !")]
    # The size of the parts does not show.
    assert [tuple(r) for r in a.fold_chunks(chunks(spark), part_chunks=4).collect()] == [("m", "Hello <think>  w</think>x!")]
