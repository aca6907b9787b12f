"""Exact statistics and candidate pairs against brute force."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import entity as E
from shelfmark.operators import money as M
from shelfmark.operators.search import bm25


def test_quantiles_of_groups_and_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 5), float(rng.randrange(4))])) for _ in range(900)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.q) for r in M.quantiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == {g for g, _ in rows}
    for g, (n, q) in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        assert n == len(own) and (np.allclose(q, np.quantile(own, shares)) if own else q == [None] * 5)
    whole = M.quantiles(df, [], "v", shares).first()
    assert np.allclose(whole.q, np.quantile([v for _, v in rows if v is not None], shares))
    assert M.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    med = {r.g: r.m for r in M.shrunk_median(df, ["g"], "v", 5, "m").collect()}
    assert med["one"] == med["none"] == whole.q[2] and med["a"] == got["a"][1][2]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_pairs_miss_none(spark):
    rng = random.Random(8)
    names = set()
    for _ in range(40):
        base = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 34)))
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
            names.add("".join(own))
    rows = [("t", n, n) for n in sorted(names)]
    got = {(r.a, r.b) for r in E.close_pairs(spark.createDataFrame(rows, "t string, k string, name string"), "t", "k", "name").collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(names - {""}), 2) if edits(a, b) * 10 <= max(len(a), len(b))}
    assert got == want


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def token_set(a, b):
    """The measure by its definition: three ratios of joined words."""
    u, v = set(a.split()), set(b.split())
    if not u or not v:
        return 0.0
    shared, left, right = (" ".join(sorted(x)) for x in (u & v, u - v, v - u))
    if shared and not (left and right):
        return 1.0
    whole = lambda x: " ".join(filter(None, (shared, x)))
    ratio = lambda x, y: 2 * common(x, y) / (len(x) + len(y))
    own = 1 - (len(left) + len(right) - 2 * common(left, right)) / (len(whole(left)) + len(whole(right)))
    return max(own, *(ratio(shared, whole(x)) if shared else 0.0 for x in (left, right)))


def test_common_length_and_token_set_ratio(spark):
    rng = random.Random(4)
    text = lambda n, s: "".join(rng.choice(s) for _ in range(rng.randrange(n)))
    cases = [("", ""), ("", "a"), ("las flores", "flores"), ("a b", "c d"), ("same same", "same"), ("  ", "x"), ("x" * 200, "y" + "x" * 150), ("q" * 61, "q" * 62), ("q" * 62, "q" * 61)]
    cases += [(text(14, "ab "), text(14, "ab ")) for _ in range(200)] + [(text(90, "abcd "), text(90, "abcd ")) for _ in range(40)] + [(text(70, "xyz\xe9漢"), text(70, "xyz\xe9漢")) for _ in range(40)]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", E.common_length(F.col("a"), F.col("b")).alias("n"), E.token_set_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert r.n == common(r.a, r.b), (r.a, r.b)
        assert abs(r.r - token_set(r.a, r.b)) < 1e-9, (r.a, r.b)


@pytest.mark.parametrize("least", [0.9, 0.8])
def test_token_set_pairs_miss_none(spark, least):
    rng = random.Random(9)
    words = ["finca", "la", "las", "flores", "floress", "buena", "vista", "esperanza", "esperansa", "el", "a", "b", "aa", "aaa", "quebraditas", "quebradita", "san", "juan"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(230)} | {"laflores", "", "  "}
    for base in list(names)[:80]:
        own = list(base)
        if own:
            own[rng.randrange(len(own))] = rng.choice(["", "x", " "])
            names.add("".join(own))
    names = sorted(names)
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(names)], "t string, k int, name string")
    got = {(r.a, r.b) for r in E.token_set_pairs(df, "t", "k", "name", least).collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(names), 2) if token_set(x, y) >= least - 1e-12}
    assert got == want and len(want) > 100


def test_bm25_counts_whole_words(spark):
    df = spark.createDataFrame([(1, "Red red-bolt"), (2, "redder"), (3, None), (4, "bolt x")], "k int, t string")
    got = {r.k: r.score for r in bm25(df, "k", "t", ["red", "bolt"]).collect()}
    idf, mean = (lambda df_: np.log(1 + (4 - df_ + 0.5) / (df_ + 0.5))), (3 + 1 + 0 + 2) / 4
    part = lambda tf, n, df_: idf(df_) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got.keys() == {1, 4} and np.isclose(got[1], part(2, 3, 1) + part(1, 3, 2)) and np.isclose(got[4], part(1, 2, 2))


def test_keyword_classes(spark):
    from shelfmark.functions import classes as C

    processes = {"Washed Anaerobic": "anaerobic_carbonic", "Lavado": "washed", "Peach Co-Ferment": "infused_cofermented", "Barrel aged natural": "barrel_aged", "Sun-Dried": "natural", "Mosto": "advanced_technical", "Giling Basah": "wet_hulled", None: "other", "": "other"}
    varieties = {"Pink Bourbon": "heirloom", "Red Bourbon": "bourbon", "SL14": "sl_varieties", "Red Catuai": "bourbon", "Gesha": "geisha", "Castillo": "hybrid", "Maragogype": "large_bean", "Bourbon Ají": "heirloom", None: "other"}
    for cases, of in ((processes, C.process_class), (varieties, C.variety_class)):
        df = spark.createDataFrame([(x,) for x in cases], "t string").select("t", of(F.col("t")).alias("c"))
        assert {r.t: r.c for r in df.collect()} == cases
