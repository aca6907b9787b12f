"""Latest versions, patches, stock state and merges: change feeds as plain frames.

Every operator takes column names. Folds over a key are aggregates, not windows, so that
Spark combines them before the shuffle and a hot key costs one row per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns (give a total order). Null
    orders come first, so a row with a value beats one without."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in any order, nulls and directions included."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def surrogate_ids(df: DataFrame, order: list[str], out: str = "id", after: int = 0) -> DataFrame:
    """Dense numbers from ``after`` + 1 in a total order: numbers within range
    partitions plus the sizes of those before, so that no task sees all rows.

    The ranges are kept in a checkpoint before sizes and rows are read from them: a range
    exchange samples its own bounds each time it is planned, and adaptive execution may
    merge its partitions otherwise, so two plans of it never agree on partition numbers."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parted = checkpoint(parted.withColumn("_at", F.monotonically_increasing_id() - F.col("_part").cast("long") * (1 << 33)))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition.
    numbered = parted.join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_at") + 1 + after).drop("_part", "_at", "_start")


def apply_patches(
    base: DataFrame, patches: DataFrame, key: str, time: str, fields: list[str], tie: str, valid: Column | None = None
) -> DataFrame:
    """``base`` with each field set to its last non-null value among the valid patches of
    the key, in order of time and tie (a null time comes first). Patches of unknown keys
    are ignored."""
    rows = patches if valid is None else patches.where(valid)
    last = rows.groupBy(key).agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(F.col(time).isNotNull(), F.col(time), F.col(tie)))).alias(f"_p_{f}")
            for f in fields
        ]
    )
    joined = base.join(last, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def stock_status(df: DataFrame, owner: str, key: str, day: str, time: str, days: DataFrame | None = None) -> DataFrame:
    """owner, key, first_seen, last_seen, in_stock: a key is in stock if it is there on
    its owner's latest day. ``days`` (owner, day) adds days on which the owner reported
    patches only; such a day counts as its latest."""
    seen = df.groupBy(owner, key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max(day).alias("_day"))
    reported = df.select(owner, day) if days is None else df.select(owner, day).unionByName(days.select(owner, day))
    latest = reported.groupBy(owner).agg(F.max(day).alias("_latest"))
    return seen.join(latest, owner).select(
        owner, key, "first_seen", "last_seen", (F.col("_day") == F.col("_latest")).alias("in_stock")
    )


def lww_merge(df: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """Last write wins; keys whose last write is a tombstone are gone."""
    marked = df.withColumn("_deleted", F.coalesce(deleted, F.lit(False)))
    return latest_by(marked, [key], order).where(~F.col("_deleted")).drop("_deleted")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], coalesce: bool = False) -> DataFrame:
    """New rows replace old ones of their key; with ``coalesce``, a null in a new row
    leaves the old value."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_o"), F.lit(True).alias("_has_o"))
    n = new.select(*keys, F.struct(*rest).alias("_n"), F.lit(True).alias("_has_n"))
    both = o.join(n, keys, "full_outer")
    pick = (
        (lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")))
        if coalesce
        else (lambda c: F.when(F.col("_has_n"), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")))
    )
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def rolling_count(df: DataFrame, key: str, time: str, seconds: int, out: str = "in_window") -> DataFrame:
    """How many rows of the key lie in the window that ends at each row, itself included."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_at", at).withColumn(out, F.count("*").over(window)).drop("_at")


def replica_digest(df: DataFrame, group: str, key: str, version: str, span: int = 1024) -> DataFrame:
    """Count and digest of each group, in two levels: a SHA-256 over the sorted
    ``key:version`` of every range of ``span`` whole keys, then one over the digests of
    ranges in order. No task lists a group's rows."""
    pair = F.struct(F.col(key), F.concat_ws(":", F.col(key).cast("string"), F.col(version).cast("string")).alias("s"))
    ranges = df.groupBy(group, F.floor(F.col(key) / span).alias("_range")).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(pair)).alias("_rows"))
    leaves = ranges.select(group, "_range", "_n", F.sha2(F.array_join(F.transform("_rows", lambda r: r["s"]), "|"), 256).alias("_leaf"))
    whole = leaves.groupBy(group).agg(F.sum("_n").alias("n_rows"), F.sort_array(F.collect_list(F.struct("_range", "_leaf"))).alias("_leaves"))
    return whole.select(group, "n_rows", F.sha2(F.array_join(F.transform("_leaves", lambda r: r["_leaf"]), "|"), 256).alias("digest"))
