"""Deduplication of tables whose ids are shared, repeated or null: exactly one row of each group stays."""

from foliotree.llm import chunk_dedup, minmax_dedup

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
OTHER = "a quite different text about the sea and a lion that nobody ever heard of"
THIRD = "here stands the third of the texts and it has nothing in common with those"


def kept(module, spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = module.kept_rows(docs)
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_shared_ids_lose_no_text(spark):
    rows = [(3, LONG, "a"), (5, LONG, "a"), (5, OTHER, "b")]
    for module in (chunk_dedup, minmax_dedup):
        assert kept(module, spark, rows) == [(3, LONG), (5, OTHER)]


def test_repeated_rows_stay_once(spark):
    rows = [(1, LONG, "a"), (2, OTHER, "a"), (None, THIRD, "a"), (4, "", "a")] * 3 + [(None, LONG, "b")]
    for module in (chunk_dedup, minmax_dedup):
        assert kept(module, spark, rows) == sorted([(1, LONG), (2, OTHER), (None, THIRD), (4, "")], key=str)


def test_sets_that_share_an_id_are_linked_each_for_itself(spark):
    near = lambda t: t + " more"
    rows = [(5, LONG, "a"), (5, OTHER, "a"), (5, THIRD, "a"), (7, near(LONG), "a"), (8, near(OTHER), "a"), (9, near(THIRD), "a"), (5, near(near(THIRD)), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False)}
    left = kept(minmax_dedup, spark, rows)
    assert len(left) == 3 and {i for i, _ in left} == {5} and {t.split()[0] for _, t in left} == {"one", "a", "here"}


def test_a_constant_id_or_none(spark):
    texts = [LONG, LONG + " more", OTHER, OTHER, THIRD]
    for doc_id in (1, None):
        rows = [(doc_id, t, "a") for t in texts]
        assert [t.split()[0] for _, t in sorted(kept(minmax_dedup, spark, rows), key=lambda r: r[1])] == ["a", "here", "one"]
        assert sorted(t for _, t in kept(chunk_dedup, spark, rows)) == sorted(set(texts))
