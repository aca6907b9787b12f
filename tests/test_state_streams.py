"""Streams with state over several runs, against folds of all rows that were not late."""
import random

from pyspark.sql import functions as F

from shelfmark.streaming import state as S

SCHEMA = "k string, t timestamp, tie long, op string, v int"


def put(spark, folder, rows):
    frame = spark.createDataFrame([(k, None, n, op, v) for k, _, n, op, v in rows], SCHEMA)
    times = spark.createDataFrame([(n, at) for _, at, n, _, _ in rows], "tie long, at long")
    frame.drop("t").join(times, "tie").select("k", F.timestamp_micros("at").alias("t"), "tie", "op", "v").coalesce(1).write.mode("append").parquet(folder)


def runs(rng, hours):
    """Three runs, each some hours later; keys come again, late and deleted; one is hot."""
    out, n = [], 0
    for run in range(3):
        rows = []
        for _ in range(120):
            n += 1
            at = (run * hours * 3600 + rng.randrange(hours * 3600 * 2)) * 1_000_000
            rows.append((rng.choice(["hot", "hot", *"abcdefg"]), at, n, rng.choice(["put", "put", "delete"]), n))
        rows += [(k, at, n + i + 1, op, v) for i, (k, at, _, op, v) in enumerate(rng.sample(rows, 10))]  # repeats
        n += 10
        out.append(rows)
    return out


def test_last_write_wins_over_three_runs(spark, tmp_path):
    rng, folder, state, seen = random.Random(3), str(tmp_path / "in.parquet"), str(tmp_path / "s"), []
    for rows in runs(rng, 5):
        put(spark, folder, rows)
        seen += rows
        got = {r.k: (r.tie, r.v) for r in S.lww_stream(spark, folder, "k", "t", "tie", "op = 'delete'", "12 hours", state).collect()}
        want = {}
        for k, at, n, op, v in sorted(seen, key=lambda x: (x[1], x[2])):
            want[k] = (n, v) if op == "put" else None
        assert got == {k: x for k, x in want.items() if x}
    again = {r.k: (r.tie, r.v) for r in S.lww_stream(spark, folder, "k", "t", "tie", "op = 'delete'", "12 hours", state).collect()}
    assert again == got


def test_writes_behind_the_watermark_are_dropped_and_states_go(spark, tmp_path):
    folder, state, day = str(tmp_path / "in.parquet"), str(tmp_path / "s"), 86_400_000_000
    table = lambda: {r.k: r.v for r in S.lww_stream(spark, folder, "k", "t", "tie", "op = 'delete'", "1 hour", state).collect()}
    put(spark, folder, [("a", day, 1, "put", 1), ("b", 2 * day, 2, "put", 2), ("c", 9 * day, 3, "put", 3)])
    assert table() == {"a": 1, "b": 2, "c": 3}
    put(spark, folder, [("a", 3 * day, 4, "put", 4), ("b", 10 * day, 5, "delete", 5), ("d", 9 * day, 6, "put", 6)])  # 3 days: late
    assert table() == {"a": 1, "c": 3, "d": 6}
    put(spark, folder, [("b", 9 * day + day // 2, 7, "put", 7), ("b", 20 * day, 8, "put", 8)])  # the first is late
    assert table() == {"a": 1, "c": 3, "d": 6, "b": 8}
    put(spark, folder, [("e", 30 * day, 9, "put", 9)])
    assert table() == {"a": 1, "c": 3, "d": 6, "b": 8, "e": 9}
    held = spark.read.format("statestore").load(f"{state}/checkpoint").select("key.k").collect()
    assert {r.k for r in held} <= {"e"}  # all others have been passed by the watermark


def test_rolling_counts_behind_the_watermark(spark, tmp_path):
    rng, folder, state, seen = random.Random(5), str(tmp_path / "in.parquet"), str(tmp_path / "s"), []
    hour = 3_600_000_000
    for rows in runs(rng, 5):
        put(spark, folder, rows)
        seen += rows
        got = {(r.k, r.tie): r.in_window for r in S.rolling_counts_stream(spark, folder, "k", "t", "tie", 4 * 3600, "12 hours", state).collect()}
        mark = max(at for _, at, *_ in seen) // 1000 - 12 * 3_600_000
        due = [(k, at, n) for k, at, n, *_ in seen if at // 1000 < mark]
        assert got == {(k, n): sum(1 for j, b, *_ in seen if j == k and at - 4 * hour <= b <= at) for k, at, n in due}
    assert len(got) > 50
    put(spark, folder, [("z", 2000 * hour, 100_000, "put", 1)])
    got = {(r.k, r.tie): r.in_window for r in S.rolling_counts_stream(spark, folder, "k", "t", "tie", 4 * 3600, "12 hours", state).collect()}
    assert got == {(k, n): sum(1 for j, b, *_ in seen if j == k and at - 4 * hour <= b <= at) for k, at, n, *_ in seen}
    held = spark.read.format("statestore").load(f"{state}/checkpoint").select("key.k").collect()
    assert {r.k for r in held} == {"z"}


def test_closed_windows_come_once(spark, tmp_path):
    rng, folder, state, seen = random.Random(8), str(tmp_path / "in.parquet"), str(tmp_path / "s"), []
    hour = 3_600_000_000
    for rows in runs(rng, 6):
        put(spark, folder, rows)
        seen += rows
        got = {(r.k, r.start): r.n for r in S.window_counts_stream(spark, folder, "k", "t", "4 hours", "2 hours", "14 hours", state).collect()}
        mark, want = max(at for _, at, *_ in seen) // 1000 - 14 * 3_600_000, {}
        for k, at, *_ in seen:
            for i in range(2):
                start = (at // (2 * hour) - i) * 2 * hour
                if (start + 4 * hour) // 1000 <= mark:
                    want[k, start] = want.get((k, start), 0) + 1
        assert got == want
    assert got
