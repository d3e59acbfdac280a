"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each end of the edges (src, dst).

    Each round every node takes the smallest label of its neighbours, then the
    label of its label, which halves long chains. Rounds are staged; one number
    per round, the count of changes, reaches the driver. A hub's edges meet its
    label in a join that adaptive execution splits, and minima are combined
    before the shuffle.
    """
    both = stage(edges.select("src", "dst").union(edges.select("dst", "src")), "edges")
    labels = stage(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("src", "root"), "src").groupBy("dst").agg(F.min("root").alias("low"))
        lower = labels.join(near, labels.node == near.dst).select("node", F.col("root").alias("was"), F.least("root", "low").alias("via"))
        jumped = lower.join(labels.toDF("via", "up"), "via").select("node", "was", F.least("via", "up").alias("root"))
        jumped = stage(jumped, "labels")
        if jumped.where("root < was").isEmpty():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
