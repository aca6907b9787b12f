"""SQLite files, files in parts, records of old shapes, and detectors against brute force."""
import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import detectors as D
from shelfmark.operators import migrate as M
from shelfmark.sources import catalogue as C
from shelfmark.sources import sqlite as S


@pytest.fixture
def feedback(tmp_path):
    path, rng = str(tmp_path / "local.db"), random.Random(1)
    rows = []
    for i in range(1000):
        fields = rng.choice(['[{"key":"decision","value":"approved"}]', '[{"key":"note","value":"x"},{"key":"decision","value":"rejected"}]', "[]", "not json", None])
        rows.append((f"id{i}", f"/p/{rng.randrange(90)}", rng.choice(["product-review", "other"]), fields, rng.choice(["new", "applied"]), rng.choice([None, 1.5, float(i)])))
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE page_feedback (id TEXT PRIMARY KEY, entity_url_path VARCHAR(99), kind TEXT, fields TEXT, status TEXT, score REAL)")
        con.executemany("INSERT INTO page_feedback VALUES (?, ?, ?, ?, ?, ?)", rows)
        con.execute("CREATE TABLE empty (a INTEGER)")
    return path, rows


def test_sqlite_tables_in_partitions_with_filters(spark, feedback):
    path, rows = feedback
    df = S.sqlite_table(spark, path, "page_feedback")
    assert df.dtypes == [("id", "string"), ("entity_url_path", "string"), ("kind", "string"), ("fields", "string"), ("status", "string"), ("score", "double")]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows)) and df.rdd.getNumPartitions() == 8
    assert S.sqlite_table(spark, path, "empty").count() == 0
    columns = "rowid long, id string, entity_url_path string, kind string, fields string, status string"
    own = S.sqlite_table(spark, path, "page_feedback", columns, 5)
    found = S.latest_decisions(own)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan sqlite_table" in plan and "= product-review" not in plan  # SQLite tests it, no Filter is left
    want = {}
    for i, (key, url, kind, fields, status, _) in enumerate(rows, 1):
        if kind == "product-review" and status == "new":
            want[url] = (key, fields)
    told = {u: (k, [e["value"] for e in json.loads(f) if e["key"] == "decision"][0]) for u, (k, f) in want.items() if f and "decision" in f}
    assert {r.entity_url_path: (r.id, r.decision) for r in found.collect()} == told


def test_filters_reach_sqlite(tmp_path, feedback):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
    from pyspark.sql.types import StructType

    path, rows = feedback
    reader = S.SqliteReader(StructType().add("id", "string"), {"path": path, "table": "page_feedback", "partitions": "3"})
    kept = list(reader.pushFilters([EqualTo(("status",), "new"), In(("kind",), ("other", "x")), StringContains(("id",), "9"), GreaterThan(("rowid",), 500)]))
    assert len(kept) == 1 and len(reader.partitions()) == 3
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("id").to_pylist()]
    assert got == [r[0] for i, r in enumerate(rows, 1) if r[4] == "new" and r[2] == "other" and i > 500]


def test_equal_tables_give_equal_parts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.choice(["a", "b", None]), i % 7) for i in range(1000)]
    seen = []
    for n in (1, 6):
        path = tmp_path / f"o{n}"
        C.written_in_parts(spark.createDataFrame(rows, "k int, t string, v int").repartition(n), str(path), ["k", "t"], 150)
        listed = sorted(((r.file, r.rows, r.first, r.last, r.sha256) for r in spark.read.json(str(path / "manifest")).collect()))
        texts = {p.parent.name: p.read_text() for p in path.glob("data/file=*/part-*")}
        assert len(texts) == len(listed) == 7
        seen.append((listed, texts))
    assert seen[0] == seen[1]
    lines = [json.loads(x) for f in sorted(seen[0][1]) for x in seen[0][1][f].splitlines()]
    key = lambda r: (r["k"], r["t"] is not None, r["t"] or "")
    assert [key(r) for r in lines] == sorted(map(key, lines)) and len(lines) == 1000 and lines[0].keys() == {"k", "t", "v"}


def test_old_shapes_become_the_newest(spark):
    zero = {"name": "A", "origin": {"country": "CO", "elevation": 1500, "latitude": 1.5}, "process": "washed", "variety": "Gesha", "harvest_date": "2024-03-01T00:00:00Z", "roast_level": "Omni", "tasting_notes": ["fig"]}
    one = {"name": "B", "origins": [{"country": "PE", "elevation": 0}, {"country": "ET", "elevation_min": 5, "elevation_max": 9, "process": "honey"}], "is_single_origin": False, "currency": "EUR"}
    two = {"name": "C", "origins": [{"country": "KE", "elevation_min": None, "elevation_max": 7}], "roast_level": "Dark"}
    texts = [json.dumps(x) for x in (zero, one, two, {"name": "D", "harvest_date": "1999-01-01"}, {"origins": [], "name": "E"})] + ["nonsense", "[1]", None]
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    df = M.migrated(spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "i int, raw string, shape2 int"), "raw", now)
    got = {r.i: r for r in df.collect()}
    assert [got[i].shape for i in range(8)] == [0, 1, 2, 0, 2, None, None, None] and got[5].bean is got[7].bean is None
    a, b, c = (got[i].bean for i in range(3))
    o = a.origins[0]
    assert (o.country, o.elevation_min, o.elevation_max, o.process, o.variety, o.harvest_date, o.latitude) == ("CO", 1500, 1500, "washed", "Gesha", "2024-03-01T00:00:00", 1.5)
    assert (a.roast_level, a.currency, a.is_single_origin, a.tasting_notes) == ("Medium", "GBP", True, ["fig"])
    assert [(x.elevation_min, x.elevation_max, x.process) for x in b.origins] == [(0, 0, None), (5, 9, "honey")] and (b.is_single_origin, b.currency) == (False, "EUR")
    assert [(x.elevation_min, x.elevation_max) for x in c.origins] == [(None, 7)] and c.roast_level == "Dark"
    assert got[3].bean.origins[0].harvest_date is None and got[4].bean.origins == []
    again = M.migrated(df.where("bean IS NOT NULL").select("i", F.to_json("bean", {"ignoreNullFields": "false"}).alias("raw")), "raw", now)
    assert {r.i: (r.shape, r.bean) for r in again.collect()} == {i: (2, got[i].bean) for i in range(5)}
    as_variant = M.migrated(spark.createDataFrame([(t,) for t in texts[:3]], "raw string").select(F.parse_json("raw").alias("raw")), "raw", now)
    assert [r.bean for r in as_variant.collect()] == [a, b, c]


def numbers(n=600):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 1, (n, 3))
    data[:12] += rng.choice([-9, 9], (12, 3))
    return [(i, *map(float, x), (1 if i < 12 else 0) if i < 12 or i % 5 == 0 else None) for i, x in enumerate(data)]


def test_detectors_equal_brute_force(spark):
    rows, names = numbers(), ["a", "b", "c"]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, odd int").repartition(5)
    trees = D.forest(df, names, "id", trees=8, rows=64)
    assert len(trees) == 8

    def depth(t, x):
        while t.column >= 0:
            t = t.left if x[t.column] < t.place else t.right
        return t.depth

    got = {r.id: r.s for r in df.select("id", D.isolation(trees, names, 64).alias("s")).collect()}
    for i, *x, _ in rows:
        assert abs(got[i] - 2 ** (-np.mean([depth(t, x) for t in trees]) / D.average_path(64))) < 1e-9
    data = np.array([r[1:4] for r in rows])
    low, high = data.min(axis=0), data.max(axis=0)
    cells = np.minimum(np.floor((data - low) / ((high - low) / 5)), 4).astype(int)
    dense = {r.id: r.g for r in D.grid_density(df, names, "g", 5).collect()}
    for i, own in enumerate(cells):
        apart = np.abs(cells - own)
        w = (apart.sum(axis=1) == 0).sum() + 0.5 * ((apart.sum(axis=1) == 1).sum())
        assert abs(dense[i] + np.log(w)) < 1e-9
    scored, learnt = D.consensus(df, names, "id", "odd")
    out = {r.id: r for r in scored.collect()}
    labelled = [r for r in rows if r[4] is not None]
    raw = {}
    for s in ("s_forest", "s_grid", "s_distance"):
        pairs = [(out[p[0]][s], out[q[0]][s]) for p in labelled for q in labelled if p[4] == 1 and q[4] == 0]
        raw[s] = max(0.0, np.mean([1.0 if x > y else 0.5 if x == y else 0.0 for x, y in pairs]) - 0.5)
        assert 0 <= min(r[s] for r in out.values()) and max(r[s] for r in out.values()) <= 1
    assert all(abs(learnt[s] - raw[s] / sum(raw.values())) < 1e-9 for s in raw) and min(learnt.values()) > 0.2
    best = sorted(out.values(), key=lambda r: -r.score)[:12]
    assert {r.id for r in best} == set(range(12))
    assert D.weights(df.withColumn("s", F.lit(0.0)).withColumn("odd", F.lit(None).cast("int")), ["s"], "odd") == {"s": 1.0}
