import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import versions as V


def test_patches_apply_in_order_and_touch_known_rows_only(spark):
    base = spark.createDataFrame([("u1", 1.0, "x"), ("u2", 2.0, "y")], "url string, price double, name string")
    patches = spark.createDataFrame(
        [("u1", 5.0, None, 2, "b"), ("u1", 4.0, "new", 1, "a"), ("u1", 900.0, None, 3, "c"), ("u9", 7.0, None, 1, "d"), ("u2", 3.0, None, None, "e")],
        "url string, price double, name string, at int, file string",
    )
    got = V.apply_patches(base, patches, "url", "at", ["price", "name"], "file", F.col("price") <= 150)
    assert sorted(map(tuple, got.collect())) == [("u1", 5.0, "new"), ("u2", 3.0, "y")]


def test_a_day_of_patches_only_takes_all_out_of_stock(spark):
    rows = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "1", 1), ("r", "a", "2", 2)], "o string, u string, d string, t int")
    plain = {r.u: r.in_stock for r in V.stock_status(rows, "o", "u", "d", "t").collect()}
    assert plain == {"a": True, "b": False}
    days = spark.createDataFrame([("r", "3")], "o string, d string")
    assert not any(r.in_stock for r in V.stock_status(rows, "o", "u", "d", "t", days).collect())


def test_surrogate_ids_are_dense(spark):
    got = V.surrogate_ids(spark.range(1000).repartition(7), ["id"], "n", after=5).orderBy("id").collect()
    assert [r.n for r in got] == list(range(6, 1006))


@pytest.mark.parametrize("merged", ["true", "false"])
def test_surrogate_ids_over_many_partitions(spark, merged):
    """Wide rows, small partitions: sizes and rows must come from one partitioning."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.enabled": merged}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        wide = spark.range(0, 60_000, 1, 9).select((F.col("id") * 7919 % 60_000).alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("filler"))
        got = V.surrogate_ids(wide, ["id"], "n")
        assert got.count() == 60_000
        assert got.where("n <> id + 1").isEmpty() and got.select("n").distinct().count() == 60_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_merge_with_tombstones_and_upserts(spark):
    df = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("j", 1, False)], "k string, v int, gone boolean")
    assert [r.k for r in V.lww_merge(df, "k", ["v"], F.col("gone")).collect()] == ["j"]
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, "e"), (3, "f", None)], "k int, x string, y string")
    assert sorted(map(tuple, V.upsert(old, new, ["k"]).collect())) == [(1, "a", "b"), (2, None, "e"), (3, "f", None)]
    assert sorted(map(tuple, V.upsert(old, new, ["k"], coalesce=True).collect())) == [(1, "a", "b"), (2, "c", "e"), (3, "f", None)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from shelfmark.streaming.feeds import latest_per_key_stream

    folder, state = str(tmp_path / "in.parquet"), str(tmp_path / "state")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    first.coalesce(1).write.parquet(folder)
    assert latest_per_key_stream(spark, folder, ["k"], ["v"], state).count() == 2
    spark.createDataFrame([("a", 3)], "k string, v int").coalesce(1).write.mode("append").parquet(folder)
    got = latest_per_key_stream(spark, folder, ["k"], ["v"], state)
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("b", 1)]
    again = latest_per_key_stream(spark, folder, ["k"], ["v"], state)  # nothing new
    assert sorted(map(tuple, again.collect())) == [("a", 3), ("b", 1)]
    spark.createDataFrame([("b", 0), ("c", 5), (None, 1)], "k string, v int").coalesce(1).write.mode("append").parquet(folder)
    got = latest_per_key_stream(spark, folder, ["k"], ["v"], state)
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 1), ("c", 5), (None, 1)}


def test_stream_notices_a_lost_state(spark, tmp_path):
    import shutil

    from pyspark.errors import StreamingQueryException
    from shelfmark.streaming.feeds import latest_per_key_stream

    folder, state = str(tmp_path / "in.parquet"), str(tmp_path / "state")
    row = lambda k: spark.createDataFrame([(k, 1)], "k string, v int").coalesce(1)
    for k in "ab":
        row(k).write.mode("append").parquet(folder)
        latest_per_key_stream(spark, folder, ["k"], ["v"], state)
    shutil.rmtree(f"{state}/lists/batch=1")
    row("c").write.mode("append").parquet(folder)
    with pytest.raises(StreamingQueryException, match="lost"):
        latest_per_key_stream(spark, folder, ["k"], ["v"], state)


def test_counts_stream_without_new_files(spark, tmp_path):
    from shelfmark.streaming.feeds import counts_stream

    folder, state = str(tmp_path / "in.parquet"), str(tmp_path / "state")
    spark.createDataFrame([("x", "2024-01-01 10:00:00")] * 2, "kind string, at string").write.parquet(folder)
    for _ in range(2):
        assert [(r.kind, r.n) for r in counts_stream(spark, folder, "at", "kind", state=state).collect()] == [("x", 2)]


def test_digests_of_replicas(spark):
    rows = [("a" if i % 2 else None, i, i * 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    whole = {r.g: (r.n_rows, r.digest) for r in V.replica_digest(df, "g", "k", "v").collect()}
    for g, found in whole.items():
        own = sorted((k, f"{k}:{v}") for h, k, v in rows if h == g)
        leaves = [hashlib.sha256("|".join(x for k, x in own if k // 1024 == r).encode()).hexdigest() for r in range(5)]
        assert found == (len(own), hashlib.sha256("|".join(leaves).encode()).hexdigest())
    other = {r.g: r.digest for r in V.replica_digest(df.where("k <> 4999"), "g", "k", "v").collect()}
    assert other["a"] != whole["a"][1] and other[None] == whole[None][1]
