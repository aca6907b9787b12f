"""Recommendations for many targets, against SQL on odd rows, and the pairs that they form."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark import plans
from shelfmark.operators import neighbours as N

QUERIES, ORACLE = plans.collect()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home, rng = tmp_path_factory.mktemp("parts"), random.Random(3)
    some = lambda *v: rng.choice(v)
    part = [(i, some("red bolt", "bolt red", "red red", "old nut", "nut", "red nut"), some("A", "A", "A", "B", "C", None), some("T", "U", None), some(1, 5, 12, 25, 48, None), 1.0) for i in range(700)]
    lines = [(i % 90, rng.randrange(600), rng.randrange(12), i, f"2024-01-0{rng.randrange(1, 4)}") for i in range(1500)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(home / f"{name}.parquet"))
    put(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    put(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string", "lineitem")
    put([(i, f"s{i}", i % 4) for i in range(10)], "s_suppkey long, s_name string, s_nationkey int", "supplier")
    put([(i, f"n{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    return home


@pytest.mark.parametrize("name", ["recommend_diversified", "recommend_by_target_facets"])
def test_pages_are_those_of_sql_with_nulls_and_repeated_notes(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    columns = ["target", "p_partkey", "score", "rk"]
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select(columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())


def test_pairs_grow_with_targets_not_with_copies(spark):
    facets = N.sets_of(N.members(F.split("name", " "), 3.0), N.facet((F.col("kind"), 0.5)))
    pairs = {}
    for n in (400, 4000):
        rows = spark.range(n).select("id", F.lit("red bolt").alias("name"), (F.col("id") % 3).cast("string").alias("owner"), F.lit("T").alias("kind"))
        targets = rows.where("id < 10").select(F.col("id").alias("target"), F.col("owner").alias("own"), facets.alias("asks"))
        pairs[n] = N.nearest(rows, targets, "id", "owner", ["name", "kind"], facets, [F.desc("id")], 5, 0.0, 1.0).count()
    assert 50 <= pairs[400] == pairs[4000] <= 10 * 23
