"""The bucketed layout: same results, no exchange on the large side, hot documents spread."""

from pyspark.sql import functions as F

from foliotree.operators import retrieval, tree
from foliotree.sources.layout import SLICE_PAGES, open_clustered, save_clustered


def data(spark):
    pages = spark.range(4000).select(
        F.when(F.col("id") < 3000, 0).otherwise((F.col("id") % 100) + 1).cast("int").alias("doc_id"), F.col("id").alias("n"))
    hot = pages.where("doc_id = 0").select("doc_id", (F.col("n") + 1).cast("int").alias("page_number"))
    rest = pages.where("doc_id > 0").select("doc_id", F.floor((F.col("n") - 3000) / 100 + 1).cast("int").alias("page_number"))
    both = hot.unionByName(rest)
    content = F.when(F.col("page_number") % 7 == 0, "").otherwise(F.concat_ws("-", "doc_id", "page_number"))
    return both.select("doc_id", "page_number", content.alias("content"), F.length(content).alias("char_count"))


def ranges(spark, hot_share=2):
    rows = []
    for q in range(300):
        doc = 0 if q % hot_share == 0 else q % 101
        last = 3000 if doc == 0 else 10
        rows += [(f"q{q}", doc, last, 1, q % last + 1, q % last + 70, "r"), (f"q{q}", doc, last, 2, -3, 2, ""), (f"q{q}", doc, last, 3, 9, 4, "none")]
    return spark.createDataFrame(rows, "question_id string, doc_id int, page_count int, rank int, page_start long, page_end long, reason string")


def exchanges(plan):
    """Exchanges that stand above a scan of bucketed files."""
    found, above = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line.strip(" :+-"))]
        if "Bucketed: true" in line:
            found += [x for _, x in above if x.startswith(("Exchange", "BroadcastExchange"))]
    return found


def test_same_pages_and_buckets(spark, tmp_path, rows):
    pages = data(spark)
    save_clustered({"doc_pages": pages}, str(tmp_path), 5)
    stored = open_clustered(spark, str(tmp_path))["doc_pages"]
    assert rows(stored.drop("page_slice")) == rows(pages)
    for share in (2, 1000):
        wanted = ranges(spark, share)
        assert rows(retrieval.ranges_to_slices(wanted, stored)) == rows(retrieval.ranges_to_pages(wanted, pages))
        questions = wanted.select("question_id", "doc_id").distinct()
        assert rows(retrieval.fallback_pages(questions, stored)) == rows(retrieval.fallback_pages(questions, pages))
    held = {r[0]: r[1] for r in stored.groupBy("page_slice").agg(F.count("*")).collect()}
    assert max(held.values()) <= SLICE_PAGES + 1000
    per_file = [r[1] for r in stored.where("doc_id = 0").groupBy(F.input_file_name()).agg(F.count("*")).collect()]
    assert len(per_file) == 5 and max(per_file) < 3000 / 2


def test_pages_are_not_exchanged(spark, tmp_path):
    pages = data(spark)
    summaries = pages.select("doc_id", "page_number", F.lit("s").alias("summary"))
    nodes = tree.root_nodes(pages.groupBy("doc_id").agg(F.lit("t").alias("title"), F.max("page_number").alias("page_count")))
    save_clustered({"doc_pages": pages, "page_summaries": summaries, "nodes": nodes}, str(tmp_path), 5)
    held = open_clustered(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = ranges(spark, 1000).where("doc_id > 0")
        plans = {
            "ranges": retrieval.ranges_to_slices(wanted, held["doc_pages"]),
            "fallback": retrieval.fallback_pages(wanted.select("question_id", "doc_id").distinct(), held["doc_pages"]),
            "beside": held["doc_pages"].join(held["page_summaries"].drop("page_number"), ["doc_id", "page_slice"]),
            "text": tree.tree_text(held["nodes"]),
        }
        for name, df in plans.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = plan.count("Bucketed: true")
            assert scans == (2 if name == "beside" else 1), plan
            assert not exchanges(plan), plan
            assert plan.count("Exchange") <= (0 if name in ("beside", "text") else 3), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_opened_by_another_session(spark, tmp_path, rows):
    pages = data(spark)
    save_clustered({"doc_pages": pages}, str(tmp_path), 3)
    for table in spark.catalog.listTables("default", "clustered_doc_pages_*"):
        spark.sql(f"DROP TABLE {table.name}")  # the files stay
    stored = open_clustered(spark, str(tmp_path))["doc_pages"]
    assert rows(stored.drop("page_slice")) == rows(pages)
    assert "Bucketed: true" in stored.join(stored.select("doc_id", "page_slice").distinct(), ["doc_id", "page_slice"])._jdf.queryExecution().executedPlan().toString()
