"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``a, b``: the smallest node that links reach.

    Each round a node takes the smallest component among its neighbours and
    then that component's own component, so long chains shorten by half.  Each
    round is written to the shared folder; links never leave the executors.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels"
    )
    held = labels
    while True:
        least = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(least, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")
        )
        # a component is the id of a node, and so has a component itself
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = materialize(
            stepped.join(jump, "component").select(
                "node", F.least("component", "further").alias("component"), "before"
            ),
            "labels",
        )
        done = after.where(F.col("component") != F.col("before")).isEmpty()
        discard(held)
        held, labels = after, after.select("node", "component")
        if done:
            discard(both)
            labels._flowlark_path = after._flowlark_path
            return labels
