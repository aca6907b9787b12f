"""Queries whose results or costs changed with larger tables."""
import duckdb
from pyspark.sql import functions as F

from shelfmark import plans

QUERIES, ORACLE = plans.collect()


def test_middles_are_rounded_as_their_sql_rounds(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s}"
    events = [(1, at("00:00.6"), 1, "signup"), (2, at("01:00.4"), 1, "signup"), (3, at("00:30.4"), 1, "click"), (4, at("00:29.5"), 1, "click"), (5, at("00:30.5"), 1, "click"), (6, at("05:00"), None, "click"), (7, at("04:00"), None, "signup"), (8, at("00:30.6"), 1, "click")]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r.seg, r.chunks, r.stitched) for r in QUERIES["range_midpoint_join"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT seg, chunks, stitched FROM ({ORACLE['range_midpoint_join']})").fetchall())


def test_locations_count_parts_without_copies_of_rows(spark, tmp_path):
    items = [(1, 5, 41.0), (1, 5, 1.0), (2, 5, 3.0), (3, 6, 50.0), (3, None, 2.0), (4, 6, None), (None, 9, 8.0), (9, 9, 8.0)]
    tables = {"lineitem": (items, "l_suppkey long, l_partkey long, l_quantity double"), "supplier": ([(1, 0), (2, 0), (3, 1), (4, 2), (5, 1)], "s_suppkey long, s_nationkey int"),
              "nation": ([(0, "n0", 0), (1, "n1", 0), (2, "n2", 1)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(0, "r0"), (1, "r1")], "r_regionkey int, r_name string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = QUERIES["location_detail"](spark, str(tmp_path))
    columns = ["loc", "suppliers", "parts", "bulk", "mean"]
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['location_detail']})").fetchall())
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_for_all_detectors(spark, tmp_path, monkeypatch):
    from shelfmark.operators import detectors

    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, " \n#" * (i % 5) + "ab c" * i) for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    consensus = detectors.consensus
    monkeypatch.setattr(detectors, "consensus", lambda rows, *a: seen.append(rows) or consensus(rows, *a))
    assert QUERIES["detector_consensus"](spark, str(tmp_path)).count() == 40
    assert "documents.parquet" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    texts = [" \n#" * (i % 5) + "ab c" * i for i in range(40)]
    share = lambda t, marks: sum(c in marks for c in t) / (len(t) + 1)
    got = {r.doc_id: (r.y, r.z) for r in seen[0].collect()}
    assert got == {i: (share(t, " \n\t"), share(t, "#*$%&|<>!")) for i, t in enumerate(texts)}


def test_slugs_keep_edges_and_need_no_table_of_characters(spark):
    from shelfmark.functions import text as T

    texts = {"-a- b--": "-a-b-", " \n- - ": "-", "--": "-", "a\x1cb\x00c": "abc", "\tK ﬁ ½\x0b": "k-fi-12", "İ-ẞ é": "i-e", "": "", None: ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.slug(F.col("t")).alias("slug"))
    assert {r.t: r.slug for r in df.collect()} == texts
    assert "translate" not in df._jdf.queryExecution().executedPlan().toString()
