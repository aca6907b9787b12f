"""Currency conversion by newest rates, and price statistics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


def latest_rates(rates: DataFrame) -> DataFrame:
    """currency, rate: the newest fetch of each (units of the currency per base unit)."""
    return rates.groupBy("currency").agg(F.max_by("rate", "fetched_at").alias("rate"))


def with_rate(df: DataFrame, rates: DataFrame, currency: str, out: str = "rate") -> DataFrame:
    """Adds the newest rate of the row's currency, null where there is none. Currencies
    are few by nature; Spark broadcasts the rates if they are small."""
    r = latest_rates(rates).select(F.col("currency").alias(currency), F.col("rate").alias(out))
    return df.join(r, currency, "left")


def to_base_for_load(price: Column, currency: Column, rate: Column) -> Column:
    """At load time: base currency or none keeps the price, null or 0 gives null, and a
    missing rate counts as 1."""
    return (
        F.when(price.isNull() | (price == 0), F.lit(None).cast("double"))
        .when(currency.isNull() | (currency == "USD"), price)
        .otherwise(price / F.coalesce(rate, F.lit(1.0)))
    )


def convert(amount: Column, source: Column, target: Column, source_rate: Column, target_rate: Column) -> Column:
    """At query time: the same currency or 0 is unchanged, a missing rate gives null."""
    return F.when((source == target) | (amount == 0), amount).otherwise(amount / source_rate * target_rate)


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value and _c, how many rows have it, in ranges of values (_part), for
    ``quantiles`` by any of the groups. Nulls do not count. Ranges lie in a checkpoint, as
    every quantile reads them more than once."""
    counted = df.groupBy(*groups, value).agg(F.count(value).alias("_c"))
    return checkpoint(counted.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """groups, n, q: exact quantiles of each group (of all rows without groups), between
    neighbouring values in proportion. Nulls do not count. ``df``: rows, or what
    ``value_counts`` makes of them.

    Counts of values are range-partitioned, so that neither a group nor all rows must fit
    into one task: ranks are sums within a range and one sum per range and group."""
    ranged = df if "_part" in df.columns else value_counts(df, groups, value)
    ranged = ranged.groupBy("_part", *groups, value).agg(F.sum("_c").alias("_c"))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per range and group.
    sums = ranged.groupBy("_part", *groups).agg(F.sum("_c").alias("_c"))
    of_group = Window.partitionBy(*groups)
    starts = sums.select("_part", *groups, before(of_group.orderBy("_part")).alias("_start"), F.sum("_c").over(of_group).alias("n"))
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in groups], "_start", "n")
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.col("_part") == F.col("_p"))
    rows = ranged.withColumn("_in", before(Window.partitionBy("_part", *groups).orderBy(value))).join(starts, same)
    rank = F.col("_start") + F.col("_in")
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    at = lambda r: F.max(F.when((rank <= r) & (r < rank + F.col("_c")), F.col(value)))
    found = rows.groupBy(*groups).agg(
        F.max("n").alias("n"), *[f(p(place(s))).alias(f"{c}{i}") for i, s in enumerate(shares) for c, f, p in (("_a", at, F.floor), ("_z", at, F.ceil))]
    )
    between = lambda i, s: F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (place(s) - F.floor(place(s)))
    return found.select(*groups, F.coalesce("n", F.lit(0)).alias("n"), F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))


def shrunk_median(df: DataFrame, groups: list[str], value: str, least: int, out: str) -> DataFrame:
    """One row per group: the group's median if it has ``least`` values or more, else that
    of all rows. Both come from the same counts (``df``: rows, or their ``value_counts``)."""
    counted = df if "_part" in df.columns else value_counts(df, groups, value)
    everything = quantiles(counted, [], value, [0.5]).select(F.col("q")[0].alias("_all"))
    joined = quantiles(counted, groups, value, [0.5]).join(F.broadcast(everything))
    return joined.select(*groups, "n", F.when(F.col("n") >= least, F.col("q")[0]).otherwise(F.col("_all")).alias(out))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its median over its interquartile range (1 if that is 0)."""
    joined = df
    for c in columns:
        joined = joined.join(F.broadcast(quantiles(df, [], c, [0.25, 0.5, 0.75]).select(F.col("q").alias(f"_q_{c}"))))

    def scaled(c):
        q = F.col(f"_q_{c}")
        width = q[2] - q[0]
        return (F.col(c) - q[1]) / F.when(width == 0, 1.0).otherwise(width)

    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; constant columns to 0."""
    bounds = df.agg(*[x for c in columns for x in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_z_{c}"))])
    joined = df.join(F.broadcast(bounds))
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_z_{c}") - F.col(f"_a_{c}")), F.lit(0.0))
    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])
