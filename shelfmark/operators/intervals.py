"""Points in intervals of the same key, which may overlap and lie within each other.

Intervals are dealt into cells of a width of their own size, the next power of two, of
which each touches two at most; a point lies in one cell of each width that occurs. The
join is on equal cells, with an exact test after, so neither a key with all points nor one
long interval is met by a task as a whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(place: str) -> Column:
    """Whole cells of 2^_level, below 0 too."""
    width = "shiftleft(CAST(1 AS BIGINT), _level)"
    return F.expr(f"({place} - pmod({place}, {width})) div {width}")


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Columns of both, ``keys`` once: every point with every interval of its keys such
    that start <= at < end (whole numbers, lengths below 2^62). Intervals without length hold nothing; null
    keys and bounds match nothing. Other columns of the two must differ by name."""
    level = F.ceil(F.log2(F.col(end).cast("double") - F.col(start).cast("double"))).cast("int")
    wide = intervals.where(F.col(start) < F.col(end)).withColumn("_level", F.greatest(level, F.lit(0)))
    # log2 may miss a power of two by an ulp, so an interval may touch a third cell.
    dealt = wide.withColumn("_cell", F.explode(F.sequence(_cell(start), _cell(f"{end} - 1"))))
    # A row: the widths that occur, 64 at most.
    levels = wide.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    each = points.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    each = each.withColumn("_cell", _cell(at))
    return each.join(dealt, [*keys, "_level", "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_cell")
