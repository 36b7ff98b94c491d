import json

from pyspark.sql import functions as F

from foliotree.completer import NullCompleter
from foliotree.operators import summaries, tree
from foliotree.operators.pagers import doc_lines


class Fixed:
    def __init__(self, responses):
        self.responses = responses

    def attach(self, requests):
        pairs = [F.when(F.col("doc_id") == n, F.lit(r)) for n, r in self.responses.items() if r is not None]
        return requests.drop("system", "prompt").withColumn("response", F.coalesce(*pairs))


def documents(spark, ids, page_count=9):
    return spark.createDataFrame([(i, f"t{i}", page_count) for i in ids], "doc_id int, title string, page_count int")


def page_rows(spark, ids, contents):
    return spark.createDataFrame([(d, n + 1, c) for d in ids for n, c in enumerate(contents)], "doc_id int, page_number int, content string")


def listed(nodes):
    out = {}
    for r in nodes.orderBy("doc_id", "path").collect():
        out.setdefault(r.doc_id, []).append((list(r.path), r.level, r.title, r.page_start, r.page_end))
    return out


def build(spark, responses, contents=("p" * 60, "", "q" * 1200)):
    docs, pages = documents(spark, responses), page_rows(spark, responses, contents)
    planned = tree.plan_trees(docs, summaries.page_summaries(pages), Fixed(responses))
    return planned, tree.build_tree(planned, pages)


FALLBACK = [([], 0, None, 1, 9), ([1], 1, "Page 1", 1, 1), ([3], 1, "Page 3", 3, 3)]


def fallback(i):
    return [(p, lv, f"t{i}" if t is None else t, a, b) for p, lv, t, a, b in FALLBACK]


def test_fallback_without_and_after_summaries(spark):
    docs = documents(spark, [1, 2])
    pages = page_rows(spark, [1], ["a" * 40, "", "b" * 40]).unionByName(page_rows(spark, [2], ["p" * 60, "", "q" * 1200]))
    planned = tree.plan_trees(docs, summaries.page_summaries(pages), NullCompleter())
    assert {r.doc_id: r.tree_source for r in planned.collect()} == {1: "none", 2: "error"}
    nodes = tree.build_tree(planned, pages)
    assert listed(nodes) == {1: fallback(1), 2: fallback(2)}
    raw = {(r.doc_id, tuple(r.path)): len(r.raw_content) for r in nodes.collect()}
    assert raw[(2, (3,))] == 1000 and raw[(1, (3,))] == 40 and raw[(1, ())] == 0
    short = tree.fallback_tree(docs, pages, tree.RAW_CHARS_NO_SUMMARY)
    assert max(len(r.raw_content) for r in short.collect()) == 500


def test_document_without_pages_has_a_root(spark):
    docs = documents(spark, [1], 0)
    pages = page_rows(spark, [1], []) if False else page_rows(spark, [2], ["x"])
    nodes = tree.build_tree(tree.plan_trees(docs, summaries.page_summaries(pages)), pages)
    assert listed(nodes) == {1: [([], 0, "t1", 1, 0)]}


def test_sections(spark):
    responses = {
        1: '{"sections": [{"title":"A"}]}',
        2: '{"sections": [{"title":"A","page_start":2,"page_end":4,"subsections":[{"title":"A1"}]}]}',
        3: '{"sections": [{"title":"A","subsections":[{"title":"A1","page_start":1,"page_end":2}]}]}',
        4: '{"sections": [{"page_start":1}]}',
        5: "prose",
        6: "{}",
        7: '{"sections": null}',
        8: '{"sections": [{"title":"A","page_end":null,"level":7,"subsections":[]}, 3]}',
        9: '{"sections": [{"title":"A","page_start":2,"page_end":null,"level":7,"subsections":[{"title":"B","page_end":3}]}]}',
        10: '{"sections": [{"title":"A","subsections":null}]}',
        11: '{"sections": ""}',
        12: '{"sections": "ab"}',
        13: '{"sections": [{"title":"A","page_start":1,"page_end":2,"subsections":[{"title":"B"},{"level":2}]}]}',
        14: '{"sections": [{"title":null,"page_start":"3","page_end":4.0}]}',
        15: None,
        16: '{"sections": [{"title":"A"}]} {"sections": []}',
    }
    planned, nodes = build(spark, responses)
    got = listed(nodes)
    assert got[1] == [([], 0, "t1", 1, 9), ([1], 1, "A", 1, 9)]
    assert got[2] == [([], 0, "t2", 1, 9), ([1], 1, "A", 2, 4), ([1, 1], 2, "A1", 2, 4)]
    assert got[6] == [([], 0, "t6", 1, 9)] and got[11] == [([], 0, "t11", 1, 9)]
    assert got[9] == [([], 0, "t9", 1, 9), ([1], 7, "A", 2, None), ([1, 1], 2, "B", 2, 3)]
    assert got[14] == [([], 0, "t14", 1, 9), ([1], 1, None, 3, 4)]
    for i in (3, 4, 5, 7, 8, 10, 12, 13, 15, 16):
        assert got[i] == fallback(i), i
    assert {r.doc_id for r in planned.where("tree_source = 'toc'").collect()} == {1, 2, 6, 9, 11, 14}


def test_failed_rollup_gives_no_tree_but_an_error(spark):
    docs = documents(spark, [1, 2])
    sums = spark.createDataFrame([(1, 1, "s", None), (2, 1, "s", [])], "doc_id int, page_number int, summary string, key_topics array<string>")
    planned = tree.plan_trees(docs, sums, Fixed({1: '{"sections":[]}', 2: '{"sections":[]}'}))
    assert [r.doc_id for r in tree.tree_errors(planned).collect()] == [1]
    assert set(listed(tree.build_tree(planned, page_rows(spark, [1, 2], ["x"])))) == {2}


def test_text_counts_and_ids(spark, rows):
    _, nodes = build(spark, {2: '{"sections": [{"title":"A","page_start":2,"page_end":null,"subsections":[{"title":"A1"},{"title":"A2","page_end":3}]},{"title":"B"}]}'})
    text = tree.tree_text(nodes).first().tree_text
    assert text == "[L0] t2 (pages 1-9)\n  [L1] A (pages 2-None)\n    [L2] A1 (pages 2-None)\n    [L2] A2 (pages 2-3)\n  [L1] B (pages 1-9)\n"
    assert rows(tree.node_counts(nodes)) == [(2, 5)]
    counts = {tuple(r.path): r.child_count for r in tree.child_counts(nodes).collect()}
    assert counts == {(): 2, (1,): 2, (1, 1): 0, (1, 2): 0, (2,): 0}
    got = nodes.collect()
    ids = {tuple(r.path): r.node_id for r in got}
    assert all(len(i) == 8 for i in ids.values()) and len(set(ids.values())) == 5
    assert all(r.parent_id == (ids[tuple(r.path[:-1])] if r.path else None) for r in got)
    assert [r.title for r in tree.preorder(nodes).collect()] == ["t2", "A", "A1", "A2", "B"]
    assert "raw_content" not in tree.public_nodes(nodes).columns


def test_nest_and_unnest(spark):
    _, nodes = build(spark, {1: '{"sections": [{"title":"A","page_start":2,"page_end":4,"subsections":[{"title":"A1"},{"title":"A2"}]},{"title":"B"}]}', 2: None})
    trees = tree.nest_tree(nodes)
    one = json.loads({r.doc_id: r.index_tree for r in trees.collect()}[1])
    assert list(one) == ["id", "title", "page_start", "page_end", "level", "content_summary", "raw_content", "children"]
    assert [c["title"] for c in one["children"]] == ["A", "B"]
    assert [c["title"] for c in one["children"][0]["children"]] == ["A1", "A2"]
    assert one["children"][1]["children"] == []
    back, errors = tree.unnest_tree(trees)
    back = back.select(*nodes.columns)
    assert errors.count() == 0
    # Fallback leaves are numbered by their page before nesting and by their place after it.
    key = ["doc_id", "node_id", "parent_id", "level", "title", "page_start", "page_end", "raw_content"]
    assert sorted(map(repr, back.select(key).collect())) == sorted(map(repr, nodes.select(key).collect()))


def test_unnest_defaults_and_required_fields(spark):
    whole = {"title": "R", "page_start": 1, "page_end": 2, "level": 0, "children": [{"id": "abc", "title": "C", "page_start": 1, "page_end": 1, "level": 1}]}
    lacking = {**whole, "children": [{"title": "C", "page_start": 1, "level": 1}]}
    df = spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(lacking)), (3, "{"), (4, None), (5, "[1]"), (6, '{"a": 1} x')], "doc_id int, index_tree string")
    nodes, errors = tree.unnest_tree(df)
    got = nodes.orderBy("path").collect()
    assert [(r.doc_id, r.title, r.content_summary, r.raw_content) for r in got] == [(1, "R", "", ""), (1, "C", "", "")]
    assert got[1].node_id == "abc" and got[1].parent_id == got[0].node_id and len(got[0].node_id) == 8
    assert sorted(r.doc_id for r in errors.collect())[:4] == [2, 3, 4, 5]


def test_trees_of_any_depth(spark):
    paths = [[]] + [[1] * n for n in range(1, 13)] + [[1, 2], [2], [2, 1], [10]] + [[3] * 1]
    rows = [(d, p, len(p), f'"{p}" \\ é', 1, 9) for d in (1, 2) for p in paths]
    nodes = tree.node_rows(spark.createDataFrame(rows, "doc_id int, path array<int>, level int, title string, page_start int, page_end int"))
    trees = tree.nest_tree(nodes.repartition(7))
    one = json.loads(trees.where("doc_id = 1").first().index_tree)
    assert [c["title"] for c in one["children"]] == [f'"[{k}]" \\ é' for k in (1, 2, 3, 10)]
    back, errors = tree.unnest_tree(trees)
    key = ["doc_id", "node_id", "parent_id", "level", "title"]
    assert sorted(map(repr, back.select(key).collect())) == sorted(map(repr, nodes.select(key).collect())) and errors.count() == 0
    # A lost ancestor, no root, or a node twice: no tree, but a reason.
    for broken in (nodes.where("path <> array(1, 1)"), nodes.where("size(path) > 0"), nodes.unionByName(nodes.where("path = array(2)"))):
        assert [(r.index_tree, r.error_message) for r in tree.nest_tree(broken).collect()] == [(None, "a node without its parent")] * 2


def test_ancestors(spark):
    _, nodes = build(spark, {1: '{"sections": [{"title":"A","page_start":2,"page_end":4,"subsections":[{"title":"A1"}]},{"title":"B"}]}'})
    chosen = nodes.where("title = 'A1'").select("doc_id", "path")
    got = sorted((r.title, r.highlighted) for r in tree.ancestors(nodes, chosen).collect())
    assert got == [("A", True), ("A1", False), ("t1", True)]
    assert [(r.title, r.highlighted) for r in tree.ancestors(nodes, chosen, as_shipped=True).collect()] == [("A1", False)]


def test_headings(spark):
    text = "intro\n# One\naaa\n## Sub a\nb\n### Deep\n## Sub b\n#### too deep\n#nothing\n# Two\n```\n# code\n ```\n### End"
    df = spark.createDataFrame([(1, text), (2, "no headings"), (3, "## A\n# B\n## C\n```\n# open end")], "doc_id int, text string")
    lines = doc_lines(df, cap=15)
    page = {r.line_no: r.page_number for r in lines.where("doc_id = 1").collect()}
    assert [r.line_no for r in lines.where("doc_id = 1 AND fenced").orderBy("line_no").collect()] == [10, 11, 12]
    got = listed(tree.heading_tree(lines, documents(spark, [1, 2, 3])))
    last = page[13]
    assert got[1] == [
        ([], 0, "t1", 1, 9), ([1], 1, "One", page[1], page[9]), ([1, 1], 2, "Sub a", page[3], page[6]), ([1, 1, 1], 3, "Deep", page[5], page[6]),
        ([1, 2], 2, "Sub b", page[6], page[9]), ([2], 1, "Two", page[9], last), ([2, 1], 3, "End", page[13], last),
    ]
    assert got[2] == [([], 0, "t2", 1, 9)]
    assert [(p, lv, t) for p, lv, t, *_ in got[3]] == [([], 0, "t3"), ([1], 2, "A"), ([2], 1, "B"), ([2, 1], 2, "C")]
    nodes, errors = tree.unnest_tree(tree.nest_tree(tree.heading_tree(lines, documents(spark, [1, 2, 3]))))
    assert listed(nodes) == got and errors.count() == 0


def slow_headings(lines, last_page):
    """Headings (level, title, page) in order → rows, by looking at all other headings."""
    heads = [(k, lv, t, p) for k, (lv, t, p) in enumerate(lines)]
    parent = {k: max((j for j, lw, *_ in heads if j < k and lw < lv), default=None) for k, lv, *_ in heads}
    place = {k: 1 + sum(parent[j] == parent[k] for j in range(k)) for k in parent}

    def path(k):
        return [] if k is None else path(parent[k]) + [place[k]]
    ends = {k: next((p for j, lw, _, p in heads if j > k and lw <= lv), last_page) for k, lv, *_ in heads}
    return sorted((path(k), lv, t, p, ends[k]) for k, lv, t, p in heads)


def test_random_headings(spark):
    import random
    draw = random.Random(2)
    given = {d: [(draw.randint(1, 6), f"h{k}", 1 + k // 3) for k in range(draw.randint(0, 25))] for d in range(40)}
    rows = [(d, 2 * k, p, "#" * lv + f" {t}", 9, False) for d, heads in given.items() for k, (lv, t, p) in enumerate(heads)]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, page_number int, line string, last_page int, fenced boolean").repartition(3)
    for max_level in (6, 3, 1):
        got = listed(tree.heading_tree(lines, documents(spark, list(given)), max_level))
        for d, heads in given.items():
            assert got[d][1:] == slow_headings([h for h in heads if h[0] <= max_level], 9)


def test_headings_are_shuffled_once(spark):
    lines = spark.createDataFrame([(1, 0, 1, "# a", 1, False)], "doc_id int, line_no int, page_number int, line string, last_page int, fenced boolean")
    plan = tree.heading_tree(lines, documents(spark, [1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_trees_of_headings_need_no_shuffle_of_their_own(spark):
    """Nesting groups the nodes where the headings were shuffled to, and trees without a fault are not joined with faulty ones."""
    lines = spark.createDataFrame([(1, 0, 1, "# a", 1, False)], "doc_id int, line_no int, page_number int, line string, last_page int, fenced boolean")
    trees = tree.nest_tree(tree.heading_tree(lines, documents(spark, [1, 2])))
    assert trees._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    nodes, errors = tree.unnest_tree(trees)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {d: len(n) for d, n in listed(nodes).items()} == {1: 2, 2: 1} and errors.count() == 0


def test_an_expensive_text_is_computed_once(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 'a.B'), (2, NULL), (3, '') AS t(doc_id, text)").write.parquet(str(tmp_path / "t"))
    lines = doc_lines(spark.read.parquet(str(tmp_path / "t")).selectExpr("doc_id", "regexp_replace(text, '[.]', '\n# ') AS text"))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert sorted((r.doc_id, r.line) for r in lines.collect()) == [(1, "# B"), (1, "a"), (3, "")]


def test_a_document_of_very_many_headings_and_fences(spark):
    """Time in proportion: four times the headings and fences, well below sixteen times the time."""
    import time

    def seconds(n):
        text = "\n".join(f"{'#' * (1 + k % 3)} heading {k}\n```\n# code\n```" for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        begin = time.perf_counter()
        top = tree.heading_tree(doc_lines(df), documents(spark, [1])).where("level = 1").agg({"page_end": "max", "ord": "max"}).first()
        assert top["max(ord)"] == -(-n // 3)
        return time.perf_counter() - begin

    seconds(1000)
    small, large = seconds(50_000), seconds(200_000)
    assert large < 10 * small + 5 and large < 90
