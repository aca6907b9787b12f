"""What several operators of this package share."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint, new_folder

__all__ = ["BLANKS", "WORD", "checkpoint", "running_total", "shared_folder", "small_batches", "word_count", "written"]

#: Blanks that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir."""
    return new_folder(spark, name)


def written(df: DataFrame, folder: str) -> DataFrame:
    """Written as Parquet and read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each row in the given total order.

    Rows are range-partitioned by the order (so that no key, however frequent, must fit
    into one task; only rows alike in the whole order stay together), kept in a checkpoint, and summed per partition; the driver sees one
    number per partition only. ``df`` should be cheap to read twice (a checkpoint)."""
    ranged = checkpoint(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    bases, held = {}, 0
    sums = {r[0]: r[1] for r in ranged.groupBy("_part").agg(F.sum(value)).collect()}
    for part in sorted(sums):
        bases[part] = held
        held += int(sums[part] or 0)
    kept = [c for c in df.columns]

    def add(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = bases[batch.column("_part")[0].as_py()]
            values = pc.fill_null(batch.column(value), 0).cast(pa.int64())
            ends = pc.add(pc.cumulative_sum(values), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pc.subtract(ends, values)], names=[*kept, out]
            )
            at = ends[-1].as_py()

    schema = df.schema.add(out, "long")
    return ranged.mapInArrow(add, schema)
