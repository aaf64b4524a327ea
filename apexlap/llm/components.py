"""Connected components by smallest label, with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that each can reach.

    Labels only ever fall, so the rounds end; with the jumps their number grows
    with the logarithm of a component's width. Repeated edges and edges of a
    node to itself do no harm; without edges the result is empty.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = written(first.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("to"), F.col("component").alias("before"))
        of = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        step = written(step.join(of, "to").select("node", F.least("to", "jump").alias("component"), "before"), "labels")
        settled = step.where("component != before").isEmpty()
        discard(labels)
        labels = step.select("node", "component")
        labels._staged_at = step._staged_at
        if settled:
            return labels
