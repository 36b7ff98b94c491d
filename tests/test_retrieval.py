from pyspark.sql import functions as F

from foliotree.operators import retrieval as r

PAGES = [(1, n, "" if n == 3 else f"c{n}", 2) for n in range(1, 7)]


class Fixed:
    def __init__(self, responses):
        self.responses = responses

    def attach(self, requests):
        pairs = [F.when(F.col("question_id") == q, F.lit(a)) for q, a in self.responses.items() if a is not None]
        return requests.drop("system", "prompt").withColumn("response", F.coalesce(*pairs))


def retrieved(spark, responses, pages=PAGES):
    questions = spark.createDataFrame([(q, 1, "why") for q in responses], "question_id string, doc_id int, message string")
    catalog = spark.createDataFrame([(1, True, len(pages))], "doc_id int, has_tree boolean, page_count int")
    texts = spark.createDataFrame([(1, "[L0] t (pages 1-6)\n")], "doc_id int, tree_text string")
    body = spark.createDataFrame(pages, "doc_id int, page_number int, content string, char_count int")
    out = r.retrieve(questions, catalog, texts, body, Fixed(responses))
    got = {}
    for row in out.orderBy("question_id", "rank", "page").collect():
        got.setdefault(row.question_id, []).append((row.page, row.reason))
    return got


FALL = [(n, "Content page") for n in (1, 2, 4, 5)]


def numbers(found):
    return [n for n, _ in found]


def test_ranges(spark):
    got = retrieved(spark, {
        "order": '[{"page_start":4,"page_end":5,"reason":"x"},{"page_start":1,"page_end":2,"reason":null}]',
        "overlap": '[{"page_start":1,"page_end":3},{"page_start":2,"page_end":4}]',
        "backwards": '[{"page_start":5,"page_end":3}]',
        "beyond": '[{"page_start":6,"page_end":99}]',
        "before": '[{"page_start":-4,"page_end":1}]',
        "six": "[" + ",".join('{"page_start":%d}' % n for n in (1, 2, 4, 5, 6, 1)) + "]",
        "none": None,
    })
    assert got["order"] == [(4, "x"), (5, "x"), (1, None), (2, None)]
    assert numbers(got["overlap"]) == [1, 2, 2, 4]
    assert "backwards" not in got
    assert numbers(got["beyond"]) == [6] and numbers(got["before"]) == [1]
    assert numbers(got["six"]) == [1, 2, 4, 5, 6]
    assert got["none"] == FALL


def test_defects(spark):
    got = retrieved(spark, {
        "prose": "no json", "wrapped": 'Sure: [{"page_start":2}] done', "think": '<think>[1]</think>[{"page_start":2}]',
        "two": "[1] x [2]", "trick": '[1],[2]', "default": "[{}]", "null": '[{"page_start":null}]', "text": '[{"page_start":"3"}]',
        "decimal": '[{"page_start":3.0}]', "number": "[3]", "nested": "[[1]]", "empty": "[]", "bool": '[{"page_start":true,"page_end":2}]',
        "late": "[" + '{"page_start":1},' * 5 + "3]", "early": "[" + '{"page_start":1},' * 4 + "3]", "endnull": '[{"page_start":1,"page_end":null}]',
    })
    assert got["wrapped"] == [(2, "")] and got["think"] == [(2, "")] and got["default"] == [(1, "")]
    assert numbers(got["late"]) == [1] * 5 and numbers(got["bool"]) == [1, 2]
    assert "empty" not in got
    for q in ("prose", "two", "trick", "null", "text", "decimal", "number", "nested", "early", "endnull"):
        assert got[q] == FALL, q


def test_top_k_counts_pages_before_the_empty_ones_go(spark):
    questions = spark.createDataFrame([("q", 1)], "question_id string, doc_id int")
    body = spark.createDataFrame(PAGES, "doc_id int, page_number int, content string, char_count int")
    assert sorted(x.page for x in r.fallback_pages(questions, body, 3).collect()) == [1, 2]


def test_no_tree_no_pages(spark):
    questions = spark.createDataFrame([("q", 1, "m"), ("p", 2, "m"), ("o", 3, "m")], "question_id string, doc_id int, message string")
    catalog = spark.createDataFrame([(1, True, 6), (2, False, 6)], "doc_id int, has_tree boolean, page_count int")
    body = spark.createDataFrame(PAGES + [(2, 1, "x", 1)], "doc_id int, page_number int, content string, char_count int")
    assert [x.question_id for x in r.with_index(questions, catalog).collect()] == ["q"]
    assert {x.question_id for x in r.retrieve(questions, catalog, None, body).collect()} == {"q"}


def test_a_huge_range_lists_existing_pages_only(spark):
    got = retrieved(spark, {"huge": '[{"page_start":1,"page_end":9000000000}]', "far": '[{"page_start":9000000000}]'})
    assert numbers(got["huge"]) == [1, 2, 4, 5, 6] and "far" not in got
