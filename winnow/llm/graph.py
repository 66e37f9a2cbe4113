"""Connected components of a table of links, as a loop of joins over shrinking label changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) for every node in ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of that label
    (path halving), so stars settle in two rounds and chains in about log(length). All state is
    in checkpointed tables; only the number of changed labels reaches the driver.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("class_id")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "class_id"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("class_id").alias("m"))
        )
        lower = labels.join(near, "node").select("node", F.col("class_id").alias("was"), F.least("class_id", "m").alias("class_id"))
        jump = labels.select(F.col("node").alias("class_id"), F.col("class_id").alias("beyond"))
        next_id = F.least("class_id", F.coalesce("beyond", "class_id"))
        step = cut(lower.join(jump, "class_id", "left").select("node", "was", next_id.alias("class_id")))
        if step.where("class_id < was").isEmpty():
            return step.select("node", "class_id")
        labels = step.select("node", "class_id")
