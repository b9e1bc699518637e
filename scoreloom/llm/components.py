"""Connected components of an edge table by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import materialised


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the undirected edges (a, b); label is the smallest vertex of its component.

    Each round takes the smallest label among neighbours and then the label's own label, so the number of rounds grows
    with the logarithm of a component's diameter. Rounds are checkpointed.
    """
    both = materialised(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct())
    labels = materialised(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        better = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("top"))
        new = materialised(better.join(jump, "label").select("v", "old", F.least("label", "top").alias("label")))
        done = new.where("old <> label").isEmpty()
        labels = new.select("v", "label")
        if done:
            return labels
