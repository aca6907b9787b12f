"""Joins, scans and trees against brute force, with keys that hold most rows."""
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import hierarchy, intervals, scans, substring
from shelfmark.sources import catalogue as C


@pytest.fixture
def split(spark):
    """Many small partitions, as a large table would have."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_substrings_of_any_length(spark, split):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcé \n%_.") for _ in range(rng.randrange(40)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    terms = {"".join(rng.choice("abcé %_.") for _ in range(rng.randrange(1, 7))) for _ in range(400)} | {"", "zzz", "z"}
    df, t = spark.createDataFrame([(*x, "x") for x in texts], "id int, body string, text string"), spark.createDataFrame([(x,) for x in terms] + [(None,)] + [("ab",)] * 3, "t string")
    got = [tuple(r) for r in substring.substring_join(df, "id", "body", t, "t").select("id", "t").collect()]
    assert sorted(got) == sorted((i, x) for i, b in texts for x in terms if x and b is not None and x in b)


def test_intervals_that_overlap_and_nest(spark, split):
    rng = random.Random(3)
    held = [(i, rng.choice(["hot", "hot", "cold"]), a, a + rng.choice([-3, 0, 1, 2, 7, 64, 65, 1000, 2**40])) for i in range(300) for a in [rng.randrange(-500, 500)]] + [(900, None, 0, 9), (901, "hot", None, 5), (902, "hot", -(2**60), 2**60)]
    points = [(i, rng.choice(["hot", "hot", "cold"]), rng.randrange(-600, 1500)) for i in range(400)] + [(900, None, 1), (901, "hot", None)]
    p, h = spark.createDataFrame(points, "p int, k string, at long"), spark.createDataFrame(held, "i int, k string, a long, b long")
    got = sorted((r.p, r.i) for r in intervals.interval_join(p, "at", h, "a", "b", ["k"]).collect())
    assert got == sorted((x, i) for x, k, at in points for i, j, a, b in held if k == j and k and None not in (at, a) and a <= at < b)


def rows(rng, n):
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(60), i, rng.choice([None, None, i])) for i in range(n)]


def test_scans_of_a_hot_key(spark, split):
    rng = random.Random(4)
    data = rows(rng, 700)
    df = spark.createDataFrame(data, "k string, t int, id int, v int").repartition(5)
    last = {r.id: r.seen for r in scans.last_seen(df, ["k"], ["t", "id"], F.col("v"), "seen").collect()}
    total = {r.id: r.n for r in scans.running_sum(df, ["k"], ["t", "id"], F.col("v"), "n").collect()}
    assert len(last) == len(total) == len(data)
    held, summed = {}, {}
    for k, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        held[k] = v if v is not None else held.get(k)
        summed[k] = summed.get(k, 0) + (v or 0)
        assert (last[i], total[i]) == (held[k], summed[k])
    assert scans.last_seen(df.limit(0), ["k"], ["t", "id"], F.col("v"), "seen").count() == 0


def test_rolling_counts_of_a_hot_key(spark, split):
    data = [(k, t, i) for k, t, i, _ in rows(random.Random(5), 500)]
    df = spark.createDataFrame(data, "k string, s int, id int").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: r.in_window for r in scans.rolling_count(df, "k", "t", "id", 7).collect()}
    assert got == {i: sum(1 for j, u, _ in data if j == k and t - 7 <= u <= t) for k, t, i in data}


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path, split):
    rng, lines, want, day = random.Random(6), ["OK early"], {}, None
    for i in range(4000):
        if rng.random() < 0.01:
            day = f"2025-01-{rng.randrange(1, 29):02}"
            lines.append(f"=== {day}")
        owner, o = f"o{rng.randrange(40)}", rng.choice(["OK", "FAIL", "noise"])
        lines.append(f"{o} {owner}")
        if day and o != "noise":
            want[owner, day] = want.get((owner, day), True) and o == "FAIL"
    (tmp_path / "a.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 5
        got = {(r.owner, r.day): r.failed for r in C.failed_days(spark, str(tmp_path / "a.log")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(9)]
    got = {(r.node, r.ancestor): r.distance for r in hierarchy.ancestors(spark.createDataFrame(chain, "n int, p int"), "n", "p").collect()}
    assert got == {(i, j): i - j for i in range(9) for j in range(i + 1)}
    rng = random.Random(7)
    tree = [(f"n{i}", f"n{rng.randrange(i)}" if i else "above") for i in range(150)]
    facts = [(f"n{rng.randrange(150)}", rng.randrange(9)) for _ in range(400)] + [("nowhere", 5)]
    sums = hierarchy.rolled_up(spark.createDataFrame(tree, "n string, p string"), "n", "p", spark.createDataFrame(facts, "at string, v int"), "at", F.sum("v").alias("v"))
    up = dict(tree)
    want, depth = {}, {}
    for n in [*up, "above"]:
        at, d = n, 0
        while at in up:
            at, d = up[at], d + 1
        depth[n] = d
    for n, v in facts:
        while n in depth:
            want[n] = want.get(n, 0) + v
            n = up.get(n)
    assert {r.n: (r.depth, r.v) for r in sums.collect()} == {n: (depth[n], want.get(n)) for n in depth}
    for bad, why in (([(1, 2), (2, 3), (3, 1), (4, 1)], "cycle"), ([(1, 1)], "cycle"), ([(1, 2), (1, 3)], "several")):
        with pytest.raises(ValueError, match=why):
            hierarchy.ancestors(spark.createDataFrame(bad, "n int, p int"), "n", "p")
