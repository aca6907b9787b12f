"""Data-quality checks as frames of (check_name, actual, threshold, passed)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(df: DataFrame, name: str, actual: Column, threshold: float, at_most: bool = True) -> DataFrame:
    """One row from an aggregate over ``df``."""
    a = df.agg(actual.cast("double").alias("actual"))
    passed = F.col("actual") <= threshold if at_most else F.col("actual") >= threshold
    return a.select(F.lit(name).alias("check_name"), "actual", F.lit(float(threshold)).alias("threshold"), passed.alias("passed"))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls in required columns, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(f"nulls in {c}").alias("check_name"), F.col(c).cast("double").alias("actual")) for c in columns])).alias("r"))
    return rows.select("r.check_name", "r.actual", F.lit(0.0).alias("threshold"), (F.col("r.actual") <= 0).alias("passed"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str, most: int = 0) -> DataFrame:
    """Distinct child keys without a parent."""
    keys = child.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    lost = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return verdict(lost, name, F.count("*"), most)


def drift(now: DataFrame, before: DataFrame, keys: list[str], count: str, most_drop: float) -> DataFrame:
    """Groups whose count fell by more than a share; new groups pass."""
    b = before.select(*keys, F.col(count).alias("before"))
    n = now.select(*keys, F.col(count).alias("now"))
    both = b.join(n, keys, "left").na.fill(0, ["now"])
    return both.withColumn("passed", F.col("now") >= F.col("before") * (1 - most_drop))


def stock_drift(counts: DataFrame, owner: str, before: str, now: str, most_drop: float = 0.3, least: int = 10) -> DataFrame:
    """scope, before, now, passed: a row for each owner, which fails if it had ``least`` or
    more and has none now, and one for all, which fails if they fell by more than a share."""
    kept = (F.col(now) > 0) | (F.col(before) < least)
    own = counts.select(F.concat_ws(" ", F.lit("owner"), F.col(owner).cast("string")).alias("scope"), F.col(before).alias("before"), F.col(now).alias("now"), kept.alias("passed"))
    every = counts.agg(F.sum(before).alias("before"), F.sum(now).alias("now"))
    return own.unionByName(every.select(F.lit("all").alias("scope"), "before", "now", (F.col("now") >= F.col("before") * (1 - most_drop)).alias("passed")))


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules (name, condition that must hold) that a row breaks. A rule on a
    null value does not count as broken."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
