import pytest
from pyspark.sql import functions as F

from shelfmark.operators import boolsearch as B
from shelfmark.operators.search import Facets, bm25, diversified, position_decay, search


@pytest.mark.parametrize(
    "text, tree",
    [
        ("dark  berry", B.Term("dark  berry")),
        ("a | b & c", B.Either((B.Term("a"), B.Both((B.Term("b"), B.Term("c")))))),
        ("!a & (b | c d)", B.Both((B.Not(B.Term("a")), B.Either((B.Term("b"), B.Term("c d")))))),
        ('not "Red Plum"', B.Not(B.Term("Red Plum", exact=True))),
    ],
)
def test_precedence_and_phrases(text, tree):
    assert B.parse(text) == tree


@pytest.mark.parametrize("text", ["a &", "| a", "(a | b", "a ) b", "", "!"])
def test_malformed_queries_raise(text):
    with pytest.raises(ValueError):
        B.parse(text)


def test_terms_against_columns(spark):
    df = spark.createDataFrame([(1, "Chocolate", ["Dark Choc", "Red Plum"]), (2, "milk chocolate", ["plum"]), (3, None, [])], "id int, name string, notes array<string>")
    hits = lambda p: [r[0] for r in df.where(p).orderBy("id").collect()]
    scalar, array = B.scalar_term(F.col("name")), B.array_term(F.col("notes"))
    assert hits(B.matches("choc*", scalar)) == [1]
    assert hits(B.matches("choc", scalar)) == [1, 2]
    assert hits(B.matches("!milk", scalar)) == [1]  # a null field is dropped
    assert hits(B.matches('"plum"', array)) == [2]
    assert hits(B.matches("choc red", array)) == [1]  # a phrase spans two notes
    assert hits(B.matches("100%", scalar)) == []


def test_position_decay_and_modes(spark):
    df = spark.createDataFrame([("a", ["plum", "fig"]), ("b", ["fig", "plums"])], "k string, n array<string>")
    got = {r.k: r.s for r in df.select("k", position_decay(F.col("n"), "plum").alias("s")).collect()}
    assert got == {"a": 5.0, "b": 0.4 * 5 / 2}
    f = Facets().must(F.col("k") != "z").wish(F.col("k") == "a", 2)
    assert [(r.k, r.score) for r in search(df, f, True, "k", "k").collect()] == [("a", 2.0)]
    assert search(df, f, False, "k", "k").count() == 1


def test_bm25_prefers_rare_terms_and_short_documents(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x" + " z" * 20), (3, "X"), (4, None)], "id int, t string")
    got = {r.id: r.score for r in bm25(df, "id", "t", ["x", "y", "none"]).collect()}
    assert set(got) == {1, 2, 3} and got[1] > got[3] > got[2]


def test_diversified_fills_up_by_rank(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", float(10 - i)) for i in range(8)], "id int, o string, s double")
    got = [r.id for r in diversified(df, "o", [F.desc("s"), F.asc("id")], 2, 5).orderBy("rk").collect()]
    assert got == [0, 1, 5, 6, 2]
