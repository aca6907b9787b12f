"""Connected components of an edge table, by joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, label: the smallest node of its component, for every node in u or v.

    Each round takes the smallest label among a node and its neighbours, then the label
    of that label, so that long chains halve; neighbours are aggregated before the
    shuffle, so a node with very many costs no more than its links. Rounds end when no
    label changes. Edges and labels stay in Spark; no edges give no rows."""
    both = checkpoint(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")))
    for _ in range(most_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = closer.select(F.col("node").alias("new"), F.col("new").alias("beyond"))
        after = checkpoint(
            closer.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("beyond", "new")).alias("label"))
        )
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels
