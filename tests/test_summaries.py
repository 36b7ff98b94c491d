from pyspark.sql import functions as F

from foliotree.completer import NullCompleter
from foliotree.operators import summaries as s

BODY = "x" * 60


class Fixed:
    """Responses by page number, taken from a table in the test."""

    def __init__(self, responses):
        self.responses = responses

    def attach(self, requests):
        pairs = [F.when(F.col("page_number") == n, F.lit(r)) for n, r in self.responses.items() if r is not None]
        return requests.drop("system", "prompt").withColumn("response", F.coalesce(*pairs))


def pages(spark, contents):
    return spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(contents)], "doc_id int, page_number int, content string")


def test_without_a_model(spark):
    long = "a" * 5000
    out = s.page_summaries(pages(spark, [None, "", " " * 100, "y" * 49 + "  ", "z" * 50, long]), NullCompleter())
    got = {r.page_number: (r.summary, r.key_topics) for r in out.collect()}
    assert got == {
        1: ("", []), 2: ("", []), 3: ("", []), 4: ("", []), 5: ("z" * 50 + "...", []), 6: ("a" * 200 + "...", []),
    }


def test_requests_hold_at_most_4000_characters(spark):
    asked = s.summary_requests(s.split_eligible(pages(spark, ["a" * 5000, "short"])))
    got = {r.page_number: r.prompt for r in asked.collect()}
    assert got[1] == s.PAGE_PROMPT + "a" * 4000 and got[2] is None


RESPONSES = {
    1: (None, (BODY + "...", [])),
    2: ("no json here", (BODY + "...", [])),
    3: ('Sure: {"summary": "s", "key_topics": ["a", "b"], "has_tables": true} done', ("s", ["a", "b"])),
    4: ('<think>{"a":1}</think>{"summary":"s"}', ("s", [])),
    5: ('{"summary":"a"} {"summary":"b"}', (BODY + "...", [])),
    6: ('{"a":1}],[{"b":1}', (BODY + "...", [])),
    7: ("{}", ("", [])),
    8: ('{"summary":null}', (None, [])),
    9: ('{"summary":"s","key_topics":[1]}', ("s", None)),
    10: ('{"summary":"s","key_topics":null}', ("s", None)),
    11: ('{"summary":5,"key_topics":"ab"}', ("5", ["a", "b"])),
    12: ('{"summary":false}', ("", [])),
    13: ('{"summary":"","key_topics":[1]}', ("", None)),
    14: ('{"summary":"s","key_topics":[]}', ("s", [])),
}


def test_model_responses(spark):
    out = s.page_summaries(pages(spark, [BODY] * len(RESPONSES)), Fixed({n: r for n, (r, _) in RESPONSES.items()}))
    assert {r.page_number: (r.summary, r.key_topics) for r in out.collect()} == {n: e for n, (_, e) in RESPONSES.items()}


def test_rollup(spark):
    df = spark.createDataFrame([
        (1, 2, "two", ["a", "b"]), (1, 1, "one", []), (1, 3, "", []), (1, 4, None, []),
        (2, 1, "", []), (3, 1, "s", None), (3, 2, "t", []), (4, 1, "", None),
    ], "doc_id int, page_number int, summary string, key_topics array<string>")
    got = {r.doc_id: (r.rollup, r.has_summary, r.failed) for r in s.rollup_summaries(df).collect()}
    assert got[1] == ("Page 1: one (Topics: )\nPage 2: two (Topics: a, b)", True, False)
    assert got[2] == ("", False, False)
    assert got[3][1:] == (True, True)
    assert got[4] == ("", False, False)


def test_unused_rollup_is_not_computed(spark):
    made = s.rollup_summaries(s.page_summaries(pages(spark, [BODY]))).select("doc_id", "has_summary")
    assert "listagg" not in made._jdf.queryExecution().optimizedPlan().toString()
