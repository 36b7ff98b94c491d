"""Indexing a part of the catalog, and indexing again."""

from foliotree.operators import summaries, tree
from foliotree.operators.pagers import page_fixed
from foliotree.plans.indexing import Index, build_index, reindex
from foliotree.plans.queries import QUERIES
from foliotree.sources.files import with_decoder_columns

CATALOG = "doc_id int, name string, index_status string, page_count int, has_tree boolean, error_message string"


def decoded(spark, rows):
    return with_decoder_columns(spark.createDataFrame([(d, t, x, None) for d, t, x in rows], "doc_id int, file_type string, text string, error_message string"))


def test_documents_that_were_not_handed_in_stay(spark):
    before = [(1, "a", "pending", 0, False, None), (2, "b", "ready", 7, True, None), (3, "c", "error", 0, False, "bad"), (4, "d", "indexing", 3, True, None)]
    catalog = spark.createDataFrame(before, CATALOG)
    made = build_index(catalog, decoded(spark, [(1, ".txt", "x" * 3001), (9, ".txt", "not in the catalog")]))
    after = {r.doc_id: tuple(r) for r in made.catalog.select(*catalog.columns).collect()}
    assert after == {1: (1, "a", "ready", 2, True, None), **{r[0]: r for r in before[1:]}}
    assert {r.doc_id for r in made.nodes.collect()} == {1}


def test_reindex_replaces_pending_documents_only(spark):
    catalog = spark.createDataFrame([(1, "a", "pending", 1, True, "old"), (2, "b", "ready", 1, True, None), (3, "c", "pending", 1, True, None),
                                     (4, "d", "pending", 1, True, None)], CATALOG)
    texts = spark.createDataFrame([(d, f"old text of {d}" * 9) for d in (1, 2, 3, 4)], "doc_id int, text string")
    pages = page_fixed(texts)
    docs = catalog.selectExpr("doc_id", "string(doc_id) AS title", "page_count")
    index = Index(catalog, pages, summaries.page_summaries(pages), tree.fallback_tree(docs, pages))
    made = reindex(index, decoded(spark, [(1, ".txt", "y" * 6001), (2, ".txt", "ready already"), (3, ".bin", "z")]))
    rows = {r.doc_id: (r.index_status, r.page_count, r.has_tree, r.error_message) for r in made.catalog.collect()}
    assert rows == {1: ("ready", 3, True, "old"), 2: ("ready", 1, True, None), 3: ("error", 1, True, "Unsupported file type: .bin"), 4: ("pending", 1, True, None)}
    pages = sorted((r.doc_id, r.page_number, r.content[:3]) for r in made.doc_pages.collect())
    assert pages == [(1, 1, "yyy"), (1, 2, "yyy"), (1, 3, "y"), (2, 1, "old"), (3, 1, "old"), (4, 1, "old")]
    assert sorted((r.doc_id, len(r.path)) for r in made.nodes.collect()) == [(1, 0), (1, 1), (1, 1), (1, 1)] + [(d, k) for d in (2, 3, 4) for k in (0, 1)]
    assert sorted({r.doc_id for r in made.page_summaries.collect()}) == [1, 2, 3, 4]


def test_counts_of_a_partial_index_without_broadcasts(spark, tmp_path):
    """Nodes are a union of joined tables; at sizes where nothing is broadcast, what is joined after it once met a union of twice its partitions."""
    spark.range(40).selectExpr("id AS doc_id", "repeat('x', int(1500 * id + 1)) AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        rows = QUERIES["build_index_partial"](spark, str(tmp_path)).select("doc_id", "error_message", "new_pages", "new_nodes").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    old = {d: ("the file is not valid UTF-8" if d % 10 == 7 else None, 0, 0) for d in range(40)}
    new = {d: ("Unsupported file type: .bin", 0, 0) if d % 12 == 0 else (old[d][0], d + 1, d + 2) for d in range(0, 40, 3)}
    assert sorted(map(tuple, rows)) == [(d, *(old | new)[d]) for d in range(40)]
