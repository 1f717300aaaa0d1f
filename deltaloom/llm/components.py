"""Connected components of a link relation, by least labels and jumps; each round is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import drop, owning, stage


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label (the smallest node that links reach) for each node of edges (a, b), staged.

    Every round takes the least label among a node and its neighbours and then that label's own label, so long
    chains shorten by doubling.  A round without a change ends it; every other lowers a label, so it does end.
    Aggregates before each exchange, so a node with many links is no hot key.  Repeated links and links of a node
    with itself are no matter; an empty relation has no nodes.
    """
    both = stage(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v").distinct(), name + "-edges")
    held = labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), name + "-labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("least"))
        )
        lower = stage(labels.join(near, "node").select("node", "label", F.least("label", "least").alias("next")), name + "-lower")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stage(
            lower.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), name + "-next")
        drop(lower, held)
        held, labels = after, after.select("node", F.col("next").alias("label"))
        if after.where("label <> next").isEmpty():
            drop(both)
            return owning(labels, after)
