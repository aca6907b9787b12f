"""Trees of any depth as tables: ancestors by pointer doubling, and sums up the tree."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


def ancestors(edges: DataFrame, node: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """node, ancestor, distance (0: the node itself) for every node and each node above it.
    ``edges`` has a row per node; a null parent marks a root, and a parent without a row of
    its own is one too. A round doubles the distance that is known, so depth d takes log d
    rounds. A cycle raises: it never comes to an end at a root."""
    own = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node IS NOT NULL").distinct()
    own = checkpoint(own)
    if not own.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node has several parents")
    steps = own.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    known = jump = checkpoint(steps)
    for k in range(most_rounds):
        if not known.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the tree has a cycle")
        if jump.isEmpty():
            break
        far = jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        # From each end of a known path on by 2^k steps; jumps are the paths of 2^k steps.
        longer = known.join(far, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("distance") + 2**k).alias("distance"))
        nearer = known
        known = checkpoint(nearer.unionByName(longer))
        jump = known.where(F.col("distance") == 2 ** (k + 1))
    nodes = own.select("node").union(steps.select("ancestor")).distinct()
    return known.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))


def rolled_up(edges: DataFrame, node: str, parent: str, facts: DataFrame, at: str, *sums) -> DataFrame:
    """node, depth and the aggregates ``sums`` over the facts of each node and all below it.
    Facts are summed per node first where Spark can, and meet their ancestors once."""
    up = ancestors(edges, node, parent)
    depth = up.groupBy("node").agg(F.max("distance").alias("depth"))
    told = facts.join(up, F.col(at) == F.col("node"), "inner").groupBy("ancestor").agg(*sums)
    return depth.join(told.withColumnRenamed("ancestor", "node"), "node", "left").withColumnRenamed("node", node)
