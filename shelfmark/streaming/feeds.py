"""Change feeds as Structured Streaming jobs that read what is new and stop.

File sources track what they have read in their checkpoint, which takes the place of an
ingestion ledger. Each run ends when all files there at its start are read; state and
results stay in the shared folder, so that the next run goes on from there. A run that
finds nothing new returns the results of the one before.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.operators.versions import latest_by
from shelfmark.shared import new_folder

#: Parts of a state; a micro-batch rewrites those that its keys fall into.
BUCKETS = 64


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of Parquet files: those of a folder, or the one file."""
    schema = spark.read.parquet(path).schema
    folder, _, last = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{last}*")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """What lies at a path, or nothing if no batch has written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class _Versions:
    """State in buckets, of which each batch writes new versions, and a list per batch of
    the version of every bucket. A batch that runs again after a failure writes the same."""

    def __init__(self, state: str, schema: StructType):
        self.state, self.schema = state, schema

    def listed(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """bucket -> batch that wrote it, by the newest list (before a batch)."""
        every = _read(spark, f"{self.state}/lists")
        last = None if every is None else every.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]
        if before and last != before - 1:
            raise RuntimeError(f"{self.state}: the list of batch {before - 1} is lost, and with it all rows before")
        return {} if last is None else {r.bucket: r.version for r in every.where(F.col("batch") == last).collect()}

    def rows(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.state}/rows/batch={v}/_bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def put(self, rows: DataFrame, n: int, versions: dict[int, int]) -> None:
        """``rows``: the new rows of the touched buckets, with a column _bucket."""
        spark = rows.sparkSession
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.state}/rows/batch={n}")
        now = spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1)
        now.write.mode("overwrite").parquet(f"{self.state}/lists/batch={n}")


def latest_per_key_stream(spark: SparkSession, path: str, keys: list[str], order: list[str], state: str | None = None) -> DataFrame:
    """Newest row per key over all runs: each micro-batch is folded to one row per key and
    merged with the buckets of the state that its keys fall into; others are not touched.
    The fold is idempotent, so a repeated batch after a failure changes nothing. A state
    whose last list is gone raises."""
    state = state or new_folder(spark, "latest")
    source = files(spark, path)
    kept = _Versions(state, source.schema)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        newest = latest_by(batch, keys, order).persist()
        touched = [r[0] for r in newest.select(bucket.alias("b")).distinct().collect()]
        before = kept.listed(own, n)
        old = kept.rows(own, {b: v for b, v in before.items() if b in touched})
        merged = latest_by(old.unionByName(newest), keys, order)
        kept.put(merged.withColumn("_bucket", bucket), n, before | dict.fromkeys(touched, n))
        newest.unpersist()

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept.rows(spark, kept.listed(spark))


def counts_stream(spark: SparkSession, path: str, time: str, kind: str, late: str = "36500 days", state: str | None = None) -> DataFrame:
    """Rows per kind and day, as a windowed aggregate in append mode would emit them; the
    final state is read from complete output, so that no window waits for a watermark."""
    state = state or new_folder(spark, "counts")
    source = files(spark, path)
    counted = (
        source.withColumn("_t", F.col(time).cast("timestamp"))
        .withWatermark("_t", late)
        .groupBy(F.window("_t", "1 day"), kind)
        .agg(F.count("*").alias("n"))
    )

    def put(batch: DataFrame, n: int) -> None:
        batch.select(kind, F.to_date("window.start").alias("day"), "n").write.mode("overwrite").parquet(f"{state}/result/batch={n}")

    query = counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    every = _read(spark, f"{state}/result")
    if every is None:
        return source.sparkSession.createDataFrame([], f"{kind} {source.schema[kind].dataType.simpleString()}, day date, n long")
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")
