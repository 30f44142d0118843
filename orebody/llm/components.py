"""Connected components of a distributed edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Every node of an edge with the smallest node that it is connected with: node, label.

    A round gives each node the smallest label among its neighbours and itself, then the label of that label; chains
    halve each round. Labels are written each round, so no lineage grows, and nothing but a count reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = offered.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        old = labels.select("node", F.col("label").alias("old"))
        jumped = least.join(of_label, "label", "left").join(old, "node").select("node", F.least("label", "next").alias("label"), "old")
        jumped = saved(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label < old").isEmpty():
            return labels
