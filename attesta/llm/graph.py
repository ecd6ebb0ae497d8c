"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest chain. Labels are written every round.
    """
    both = save(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("beyond"))
        moved = save(lower.join(jump, "low").select("node", F.least("low", "beyond").alias("comp"), (F.least("low", "beyond") < F.col("comp")).alias("moved")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("moved").isEmpty():
            return labels
