"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.store import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b) of bigint nodes: label is the least node of its component.

    Each round a node hears the least label among its neighbours, hands it to the node whose label it
    has carried so far, and both take what is lower; then every label is followed one step further. So
    whole trees of labels join at their roots, and paths of labels halve. Rounds end when no label
    changes; then both ends of every link agree. Every round is written as a table, so the lineage stays
    short. What many nodes tell one root is reduced before it is shuffled.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near"), "links")
    labels = settle(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("heard")), "near")
        told = labels.join(heard.groupBy("node").agg(F.min("heard").alias("heard")), "node")
        told = settle(told.select("node", F.col("label").alias("was"), F.least("label", "heard").alias("heard")), "told")
        calls = told.select("node", "heard").union(told.select("was", "heard"))
        lower = settle(calls.groupBy("node").agg(F.min("heard").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = settle(lower.join(jump, "label").select("node", F.col("further").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("was <> label").limit(1).count()
        labels = after
        if not changed:
            return labels
