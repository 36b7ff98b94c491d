"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliotree.functions.durable import stored


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, label)`` of every node of ``links (a, b)``: the smallest node that it is connected with.

    ``known`` has labels of an earlier run whose links hold as well. Each round
    hands the smallest label over every link and then follows labels once
    (pointer jumping), so rounds grow with the logarithm of a chain's length. A
    node with many links is combined before the shuffle; labels are a stored
    table in every round. Null ends, self links and repeated links change nothing.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    if known is not None:
        links = links.unionByName(known.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        offered = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(offered.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        # The label is a node, too; where that one has a lower label by now, take it.
        jumped = lower.join(labels.select(F.col("node").alias("via"), F.col("label").alias("further")), F.col("label") == F.col("via"), "left")
        fresh = stored(jumped.select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where("label <> old").isEmpty():
            return labels
