"""Exact products and their windows against plain integers."""
import math
import random

import duckdb
import numpy as np
import pytest

from shelfmark.llm import negatives


@pytest.mark.parametrize("width, most", [(1, 3), (64, 200), (64, 100_000), (1500, 4000), (3, 2**26)])
def test_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (7, 33))
    a[0], b[0], b[1] = most, most, -most
    own = negatives.Product(a, width * most * most)
    half = [p // 2 for p in own.primes]
    assert math.prod(own.primes) > 2 * width * most * most and all(h * h * min(width, 1024) <= 1 << 24 for h in half)
    assert (own.scores(b) == a @ b.T).all()


def moved(i, label):
    return int(math.fmod(label + 1, 10)) if i % 7 == 0 else label


def brute(rows):
    rows = [(i, moved(i, l), [math.floor(256 * x) for x in e]) for i, e, l in rows if None not in (i, e, l) and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, e in rows:
        if i % 50:
            continue
        every = [(-dot(e, f), j, m) for j, m, f in rows if j != i]
        for s, j, _ in sorted((s, j, m) for s, j, m in every if m == label)[:5]:
            fit = sorted((t, k) for t, k, m in every if m != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit[:3], 1)]
    return sorted(out)


def vectors(n, seed=12):
    rng = random.Random(seed)
    base = [[np.float32(rng.gauss(0, 0.3)).item() for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(-100, n):
        label = rng.randrange(-2, 4)
        e = [float(np.float32(x + rng.gauss(0, 0.1))) for x in base[label]]
        rows.append((i, rows[-1][1] if rng.random() < 0.2 and rows else e, label))  # ties
    return rows


@pytest.mark.parametrize("block", [2048, 3])
def test_triples_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ROWS", 32)
    rows = vectors(250)
    odd = [(None, [1.0] * 6, 1), (1000, None, 1), (1050, [1.0] * 6, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (1150, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 1), (1250, [], 2), (1300, [0.5, 0.5], 1), (1301, [0.25], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, score int, v string").repartition(4)
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == brute(rows + odd) and len(got) > 30


def test_nothing_to_mine(spark):
    df = spark.createDataFrame(vectors(60), "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df.limit(0)).count() == negatives.mine(df.where("vec_id % 50 <> 0")).count() == negatives.mine(df.where("vec_id = 50")).count() == 0
    with pytest.raises(ValueError, match="do not fit"):
        negatives.mine(spark.createDataFrame([(50, [3e30], 1)], "vec_id long, embedding array<float>, label int"))


def test_whole_table_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.OP12_SQL})").fetchall())
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.op12_hard_negatives(spark, folder).collect())
    assert got == want and len(want) > 20
