"""The stored index against a scan of the same texts."""
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import postings as P
from shelfmark.operators.search import bm25


def corpus(rng, keys):
    words = ["red", "Ring", "bolt", "gear", "the", "the", "x1y", "old"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30]))) or None, [rng.choice(words) for _ in range(rng.randrange(3))]) for k in keys]


def scanned(df, terms):
    docs = df.select("k", F.concat_ws(" ", "t", F.array_join("notes", " ")).alias("all"))
    return {r.k: round(r.score, 6) for r in bm25(docs, "k", "all", terms).collect()}


def indexed(index, terms, **more):
    return {r.key: round(r.score, 6) for r in index.scores(terms, **more).collect()}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(P, "SPAN", 8)
    monkeypatch.setattr(P, "PROBED", 2)


SCHEMA = "k string, t string, notes array<string>"


def test_scores_after_changes_are_those_of_a_scan(spark, tmp_path, small):
    rng, terms = random.Random(1), ["red", "ring", "wa", "nowhere"]
    rows = dict((r[0], r) for r in corpus(rng, [f"k{i}" for i in range(120)]))
    frame = lambda: spark.createDataFrame(list(rows.values()), SCHEMA)
    index = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"], 4).build(frame())
    assert indexed(index, terms) == scanned(frame(), terms)
    for step in range(3):
        new = corpus(rng, [f"k{i}" for i in rng.sample(range(140), 15)])
        gone = [k for k in rng.sample(sorted(rows), 6) if k not in {r[0] for r in new}]
        index.update(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(k,) for k in gone], "k string"))
        rows = {k: r for k, r in rows.items() if k not in gone} | {r[0]: r for r in new}
        assert indexed(index, terms) == scanned(frame(), terms), step
    again = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"], 4)
    assert indexed(again, terms) == scanned(frame(), terms)
    every = scanned(frame(), ["red", "the", "wb"])
    best = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:7]
    top = sorted(((r.key, round(r.score, 6)) for r in index.top(["red", "the", "wb"], 7).collect()), key=lambda x: (-x[1], x[0]))
    assert top[:7] == best
    counts = index.compared(frame()).first()
    assert (counts.docs, counts.listed, counts.missing, counts.extra) == (len(rows), len(rows), 0, 0)


def test_fields_can_be_chosen(spark, tmp_path):
    df = spark.createDataFrame([("a", "red", ["blue"]), ("b", "blue", []), ("c", None, None)], SCHEMA)
    index = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"]).build(df)
    assert indexed(index, ["blue"]).keys() == {"a", "b"} and indexed(index, ["blue"], fields=["t"]).keys() == {"b"}
    assert index.top(["nowhere"], 3).count() == 0


def test_a_search_reads_the_buckets_of_its_terms_and_few_ranges(spark, tmp_path, small):
    rows = [(f"k{i}", "common " * 20 + ("rare " * 3 if i % 97 == 0 else ""), []) for i in range(400)]
    index = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"], 16).build(spark.createDataFrame(rows, SCHEMA))
    own = spark.range(1).select(index._bucket(F.lit("rare"))).first()[0]
    found = index.scores(["rare"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1]
    files = index._segments("blocks", ["rare"]).select(F.input_file_name()).distinct().collect()
    assert files and all(f"bucket={own}/" in f[0] for f in files)
    opened = []
    scores = index.scores
    index.scores = lambda *a, **b: opened.append(b["ranges"].count()) or scores(*a, **b)
    assert index.top(["rare", "common"], 2).count() >= 2
    whole = index._segments("blocks", ["common"]).count()
    assert opened[0] == 2 and opened[1] < whole / 2


def test_blocks_are_made_range_by_range_and_a_common_term_is_spread(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(P, "RANGES", 4)
    rows = [(f"k{i}", "Common Łódź common x", ["common"] if i % 2 else None) for i in range(200)]
    index = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"], 4).build(spark.createDataFrame(rows, SCHEMA))
    blocks = index._segments("blocks", ["common"])
    docs = blocks.select(F.explode("docs").alias("d")).select("d.*").collect()
    assert sorted((d.key, d.len, d.tfs) for d in docs) == sorted((k, 4 + bool(n), [2, int(bool(n))]) for k, _, n in rows)
    assert blocks.select(F.input_file_name()).distinct().count() > 1
    plan = index._blocks(index.forward(), 25)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning(range") == 1


def test_a_failed_update_leaves_the_old_index(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "red", []), ("b", "red red", [])], SCHEMA)
    index = P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"]).build(df)
    before = indexed(index, ["red"])
    monkeypatch.setattr(index.manifest, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.update(spark.createDataFrame([("a", "blue", [])], SCHEMA))
    assert indexed(P.Index(spark, str(tmp_path / "i"), "k", ["t", "notes"]), ["red"]) == before
