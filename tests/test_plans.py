"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

from foliotree.operators import pagers, retrieval, summaries, tree
from foliotree.operators.answers import assemble
from foliotree.plans import answering
from foliotree.plans.inputs import Inputs
from foliotree.sources import tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, DATA)


@pytest.fixture(scope="module")
def stored(spark, inputs, tmp_path_factory):
    """Pages on disk: what a plan reads of them shows in its scans."""
    folder = str(tmp_path_factory.mktemp("plans"))
    tables.save({"doc_pages": inputs.pages, "catalog": inputs.catalog}, folder, files=2)
    return tables.load(spark, folder, "doc_pages", "catalog")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange (?:hash|range|Single)", plan(df)))


def test_page_rows_and_summaries_are_narrow(inputs):
    pages = pagers.page_fixed(inputs.table("documents"))
    assert shuffles(pages) == 0
    assert shuffles(summaries.page_summaries(pages)) == 0
    assert shuffles(tree.fallback_tree(inputs.docs, pages)) == 0


def test_an_expensive_array_is_made_once(inputs):
    assert plan(inputs.pages).count("regexp_extract_all") == 1
    assert plan(pagers.page_lines(inputs.documents)).count("aggregate(slice(") == 1


def test_rollup_and_text_shuffle_once(stored):
    assert shuffles(summaries.rollup_summaries(summaries.page_summaries(stored["doc_pages"]))) == 1


def test_first_pages_filter_reaches_the_scan(stored):
    text = plan(retrieval.first_pages(stored["doc_pages"]))
    assert "LessThanOrEqual(page_number,5)" in text and "IsNotNull(page_number)" in text


def test_context_moves_prefixes_only(stored):
    exchange = plan(assemble(retrieval.first_pages(stored["doc_pages"]), "doc_id")).split("Exchange hash")[1]
    assert "content" not in exchange.split("+- ")[0] and "substring(content" in exchange


def test_headings_shuffle_once_and_page_the_text_once(inputs):
    made = tree.heading_tree(pagers.doc_lines(inputs.table("documents")), inputs.docs)
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan(made))) == 1
    assert plan(made).count("aggregate(slice(") == 1


def test_few_wanted_pages_do_not_shuffle_the_corpus(spark, stored):
    ranges = spark.createDataFrame([("q", 1, 9, 1, 1, 3, "")], "question_id string, doc_id long, page_count int, rank int, page_start long, page_end long, reason string")
    ranges_plan = retrieval.ranges_to_pages(ranges, stored["doc_pages"], small=True)
    # The keys of the pages wanted are made distinct, and what is left of the pages is joined; nothing else moves.
    scan = plan(ranges_plan).split("FileScan parquet")[0].rsplit("Exchange", 1)[1]
    assert "BroadcastHashJoin" in scan and "LeftSemi" in scan


def test_counts_read_no_text(stored):
    text = plan(pagers.page_counts(stored["catalog"], stored["doc_pages"]))
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == ["doc_id:bigint", "doc_id:bigint"]


def test_whole_plans_have_no_cross_join_and_no_row_python(inputs):
    made = [
        answering.fallback_context(inputs.questions, inputs.conversations, inputs.catalog, inputs.pages),
        tree.build_tree(tree.plan_trees(inputs.docs, summaries.page_summaries(inputs.pages)), inputs.pages),
    ]
    for df in made:
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_only_bounded_tables_are_hinted_for_broadcast():
    """A broadcast hint stands only beside hot keys (fewer than the shuffle partitions), a single conversation or row of
    bounds, and keys that were counted before."""
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "foliotree")
    found = {}
    for folder, _, names in os.walk(root):
        for name in names if os.path.basename(folder) != "llm" else []:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    hints = re.findall(r"broadcast\((\w+)", f.read())
                if hints:
                    found[name] = sorted(set(hints))
    assert found == {"skew.py": ["hot"], "catalog.py": ["chosen", "gone", "keys"], "retrieval.py": ["asked", "hot", "wanted"],
                     "versions.py": ["bounds", "gone"]}
