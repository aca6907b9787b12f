"""Report building blocks: shares, completeness grids, top-n with a rest, classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first rule (class, pattern) that matches."""
    (name, pattern), *rest = rules
    out = F.when(text.rlike(pattern), name)
    for name, pattern in rest:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def top_with_other(df: DataFrame, node: str, item: str, count: str, keep: int, out: str, total: str) -> DataFrame:
    """The first ``keep`` items of each node; what remains as 'Other', if two or more do."""
    w = Window.partitionBy(node)
    rank = F.row_number().over(w.orderBy(F.desc(count), F.asc(item)))
    rows = df.select(node, item, count, rank.alias("_rank"), F.count("*").over(w).alias("_k"))
    label = F.when((F.col("_rank") <= keep) | (F.col("_k") - keep < 2), F.col(item)).otherwise("Other")
    return rows.groupBy(node, label.alias(out)).agg(F.sum(count).alias(total))


def share_grid(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n, share (percent of the group) for every pair of a group and a value
    that occur at all, 0 where they do not meet. Grows with groups times values, which
    are few; rows are counted before."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    grid = n.select(group).distinct().crossJoin(n.select(value).distinct())
    full = grid.join(n, [group, value], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy(group)))


def over_index(df: DataFrame, owner: str, category: str, least: int = 3, share: float = 0.1, lift: float = 0.02, peers: float = 60) -> DataFrame:
    """Categories that stand out in an owner's mix: enough rows, a share well above that
    of all owners, and above that of most owners who have the category. One pass for all
    owners at once: rows become counts first, and all that follows is on counts."""
    c = df.groupBy(owner, category).agg(F.count("*").alias("n"))
    own, cat, every = Window.partitionBy(owner), Window.partitionBy(category), Window.partitionBy()
    s = c.select(
        owner,
        category,
        "n",
        (F.col("n") / F.sum("n").over(own)).alias("share"),
        (F.sum("n").over(cat) / F.sum("n").over(every)).alias("_all"),
        F.sum("n").over(own).alias("_total"),
    )
    p = s.withColumn("lift", F.col("share") - F.col("_all")).withColumn(
        "pct", (F.rank().over(cat.orderBy("share")) - 1) * F.lit(100.0) / F.count("*").over(cat)
    )
    enough = (F.col("n") >= least) & (F.col("share") >= F.greatest(F.lit(share), F.lit(float(least)) / F.col("_total")))
    return p.where(enough & (F.col("lift") > lift) & (F.col("pct") > peers)).drop("_all", "_total")
