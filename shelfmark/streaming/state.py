"""Streams with state per key: last write wins, and how much has come of late.

Both use event time and a watermark, so that what a key has to remember ends: a write older
than the watermark is late and dropped, and a state that only late writes could meet goes.
Each run reads what is new and stops; the state goes on in the folder given.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.shared import new_folder
from shelfmark.streaming.feeds import BUCKETS, _read, _Versions, files


#: Times as text without loss.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _run(rows: DataFrame, put, state: str) -> None:
    query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def lww_stream(spark: SparkSession, path: str, key: str, time: str, tie: str, deleted: str, late: str = "1 day", state: str | None = None) -> DataFrame:
    """The rows of a table that is written by upserts and tombstones (a SQL condition),
    over all runs so far. Of a key the write with the greatest ``time`` and then ``tie``
    counts, in whatever order writes come; a key whose last write is a tombstone is gone.

    A key's state is the place of its last write. Once the watermark has passed it no write
    can lose against it, so it is forgotten: the state holds the keys written of late,
    whatever the size of the table. The table lies in buckets, of which a batch rewrites
    those that its winners fall into."""
    state = state or new_folder(spark, "lww")
    source = files(spark, path)
    columns = [c for c in source.columns]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    data = F.to_json(F.struct(*columns), _EXACT)
    rows = source.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("_t"), at.alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.expr(deleted), F.lit(False)).alias("gone"), data.alias("data"))
    kind = source.schema[key].dataType.simpleString()

    def newest(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before = held.get if held.exists else None
        best, winner = before, None
        for part in parts:
            i = np.lexsort((part["tie"].to_numpy(), part["at"].to_numpy()))[-1]
            own = (int(part["at"].iloc[i]), int(part["tie"].iloc[i]))
            if best is None or own > best:
                best, winner = own, part.iloc[[i]]
        if winner is not None:
            held.update(best)
            yield winner[["k", "at", "tie", "gone", "data"]]
        held.setTimeoutTimestamp(max(best[0] // 1000, held.getCurrentWatermarkMs()) + 1)

    won = rows.withWatermark("_t", late).groupBy("k").applyInPandasWithState(newest, f"k {kind}, at long, tie long, gone boolean, data string", "at long, tie long", "update", GroupStateTimeout.EventTimeTimeout)
    kept = _Versions(state, source.schema)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def put(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        new = batch.select("gone", F.from_json("data", source.schema, _EXACT).alias("d")).select("gone", "d.*").persist()
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]
        before = kept.listed(own, n)
        old = kept.rows(own, {b: v for b, v in before.items() if b in touched})
        rest = old.join(new.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        merged = rest.unionByName(new.where("NOT gone").drop("gone")).withColumn("_bucket", bucket).persist()
        full = [r[0] for r in merged.select("_bucket").distinct().collect()]  # a bucket may have lost its last row
        kept.put(merged, n, {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(full, n))
        merged.unpersist()
        new.unpersist()

    _run(won, put, state)
    return kept.rows(spark, kept.listed(spark))


def rolling_counts_stream(spark: SparkSession, path: str, key: str, time: str, ident: str, seconds: int, late: str = "1 hour", state: str | None = None) -> DataFrame:
    """key, ident, time (microseconds), in_window: how many rows of the key lie in the
    window that ends at each row, itself included, over all runs so far. A row is given out
    once, when the watermark has passed it, as no row that counts for it can come any more:
    so counts are those of all rows that were not late, in whatever order they came. A
    key's state holds its rows that wait, and the times of the last window; it goes when
    the watermark has passed all of it."""
    state = state or new_folder(spark, "rolling")
    source = files(spark, path)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = source.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("_t"), at.alias("at"), F.col(ident).cast("long").alias("ident"))
    kind, span = source.schema[key].dataType.simpleString(), seconds * 1_000_000

    def count(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        past, wait, ids = (np.array(x, np.int64) for x in held.get) if held.exists else (np.zeros(0, np.int64),) * 3
        if not held.hasTimedOut:
            for part in parts:
                wait, ids = np.concatenate([wait, part["at"].to_numpy()]), np.concatenate([ids, part["ident"].to_numpy()])
        order = np.lexsort((ids, wait))
        wait, ids = wait[order], ids[order]
        now = held.getCurrentWatermarkMs()
        n = int(np.searchsorted(wait, now * 1000, side="left"))
        times = np.concatenate([past, wait[:n]])
        if n:
            counts = np.searchsorted(times, wait[:n], side="right") - np.searchsorted(times, wait[:n] - span, side="left")
            yield pd.DataFrame({"k": [k[0]] * n, "ident": ids[:n], "at": wait[:n], "in_window": counts.astype(np.int64)})
        times = times[np.searchsorted(times, now * 1000 - span, side="left") :]
        wait, ids = wait[n:], ids[n:]
        if not len(times) and not len(wait):
            held.remove()
            return
        held.update((times.tolist(), wait.tolist(), ids.tolist()))
        due = wait[0] // 1000 if len(wait) else (times[-1] + span) // 1000 + 1
        held.setTimeoutTimestamp(int(max(due, now + 1)))

    counted = rows.withWatermark("_t", late).groupBy("k").applyInPandasWithState(count, f"k {kind}, ident long, at long, in_window long", "past array<bigint>, wait array<bigint>, ids array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/result/batch={n}")

    _run(counted, put, state)
    found = _read(spark, f"{state}/result")
    names = {"k": key, "ident": ident, "at": "at", "in_window": "in_window"}
    return found.drop("batch").withColumnsRenamed(names) if found is not None else spark.createDataFrame([], f"{key} {kind}, {ident} long, at long, in_window long")


def window_counts_stream(spark: SparkSession, path: str, key: str, time: str, size: str, slide: str, late: str = "1 hour", state: str | None = None) -> DataFrame:
    """key, start (microseconds), n: rows in each sliding window that the watermark has
    closed, in append mode: each window once, and none of them left in the state."""
    state = state or new_folder(spark, "windows")
    source = files(spark, path)
    kind = source.schema[key].dataType.simpleString()
    counted = source.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("_t")).withWatermark("_t", late).groupBy(F.window("_t", size, slide).alias("w"), "k").agg(F.count("*").alias("n"))
    shown = counted.select("k", F.unix_micros("w.start").alias("start"), "n")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/result/batch={n}")

    query = shown.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = _read(spark, f"{state}/result")
    return found.drop("batch").withColumnRenamed("k", key) if found is not None else spark.createDataFrame([], f"{key} {kind}, start long, n long")
