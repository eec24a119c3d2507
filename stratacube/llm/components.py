"""Connected components of an edge table, by repeated least labels and pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (a, b: long). A node without edges isn't there.

    Each round gives a node the least label among itself and its neighbours, then the label of that label. Sums are
    combined before they are shuffled, so a node with very many edges doesn't meet in one task. Each round's labels are
    a table in the shared folder. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        after = stored(hooked.join(jump, "m", "left").select("node", "old", F.least("m", "up").alias("component")), "labels")
        done = after.filter(F.col("old") != F.col("component")).isEmpty()
        dropped(labels)
        labels = after.drop("old")
        if done:
            dropped(both)
            return labels
