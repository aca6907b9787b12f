"""Ordered scans whose keys may be larger than a task.

Rows are range-partitioned by key and order and kept in a checkpoint. Each range is
scanned by itself; what a key carries from one range to the next is one row per range and
key, scanned in turn, and added to the rows of the range. So a key with all rows is dealt
to as many tasks as any other data of its size.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


def _scanned(df: DataFrame, keys: list[str], order: list[str], inside: Column, tail: Column, before: Column, joined: Column, out: str) -> DataFrame:
    """``inside``: the scan of a range's rows of a key. ``tail``: what they carry on, an
    aggregate. ``before``: the scan of tails (_tail) of the ranges before. ``joined`` puts
    _inside and _before together."""
    ranged = checkpoint(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tails = ranged.groupBy("_part", *keys).agg(tail.alias("_tail"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    carried = tails.select(F.col("_part").alias("_p"), *named, before.over(ahead).alias("_before")).where("_before IS NOT NULL")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    rows = ranged.withColumn("_inside", inside.over(own)).join(carried, same, "left")
    return rows.withColumn(out, joined).select(*df.columns, out)


def last_seen(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the last value that is not null of the rows of the key up to each row, itself
    included, in a total order."""
    named = df.withColumn("_v", value)
    place = F.struct(*order)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), place))
    found = _scanned(named, keys, order, F.last("_v", ignorenulls=True), last, F.last("_tail", ignorenulls=True), F.coalesce("_inside", "_before"), out)
    return found.drop("_v")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of a value over the rows of the key up to each row, itself included."""
    named = df.withColumn("_v", value)
    found = _scanned(named, keys, order, F.sum("_v"), F.sum("_v"), F.sum("_tail"), F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0)), out)
    return found.drop("_v")


def rolling_count(df: DataFrame, key: str, time: str, ident: str, seconds: int, out: str = "in_window") -> DataFrame:
    """ident and how many rows of the key lie in the window that ends at each row's time,
    its peers and itself included. Each row asks twice for a running count, before its
    window begins and after its own time, and takes the difference."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(F.col(key).alias("_k"), at.alias("_at"), F.col(ident).alias("_id"))
    asked = rows.select("_k", "_id", F.explode(F.array(F.struct((F.col("_at") - seconds * 1_000_000).alias("_t"), F.lit(0).alias("_kind")), F.struct(F.col("_at").alias("_t"), F.lit(1).alias("_kind")), F.struct(F.col("_at").alias("_t"), F.lit(2).alias("_kind")))).alias("s"))
    events = asked.select("_k", "_id", "s._t", "s._kind")
    counted = running_sum(events, ["_k"], ["_t", "_kind", "_id"], (F.col("_kind") == 1).cast("long"), "_n")
    signed = F.when(F.col("_kind") == 2, F.col("_n")).when(F.col("_kind") == 0, -F.col("_n"))
    return counted.groupBy("_k", "_id").agg(F.sum(signed).alias(out)).withColumnsRenamed({"_k": key, "_id": ident})
