"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, its component's smallest node, for every node of ``links`` (a, b).

    Each round maps every node to its smallest neighbour or that one's, and contracts the links to the nodes
    left.  A component's smallest node is never mapped away, so it is what is left of the component.
    At least every second node of a component goes in a round, so rounds grow with the logarithm of the longest path.  Minima combine
    before the shuffle; a hub's links are joined with a staged table, which the adaptive planner may
    split or broadcast by its true size.  No links give no rows.
    """
    edges = stage(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        near = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")), "nearest")
        further = near.select(F.col("node").alias("to"), F.col("to").alias("then"))
        near = stage(near.join(further, "to").select("node", F.col("then").alias("to")), "mapped")
        if labels is None:
            labels = near.withColumnRenamed("to", "label")
        else:
            onward = near.withColumnRenamed("node", "label")
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = stage(labels, "labels")
        a = near.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = near.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(a, "a").join(b, "b").select(
            F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")
        )
        edges = stage(edges.where("a <> b").distinct(), "links")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
