"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import durable


def connected(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of ``edges`` (a, b: long).

    Each round takes the least label among the neighbours and then the label's own label, until nothing
    changes; only the number of changes goes to the driver. A round's result is checkpointed."""
    both = durable(edges.union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("further"))
        jumped = durable(lower.join(heads, lower["next"] == heads["head"], "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"), F.col("label").alias("was")))
        changed = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
