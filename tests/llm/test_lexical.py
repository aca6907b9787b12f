"""Ranked search against brute force in plain integers."""
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from shelfmark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    return Counter(t.translate(LOW) for t in TERM.findall(text or ""))


def brute(docs, items, top):
    bags = [(d, bag(t)) for d, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for key, text in items:
        own, scored = bag(text), []
        for d, b in bags:
            if d is None or not b:
                continue
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, k in own.items() if t in b)
            if s > 0:
                scored.append((-s, d))
        out += [(key, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["red", "Red", "blue", "sch\xf6n", "漢字", "x1", "42", "the", "the", "the", "ring"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 2, 3, 8, 40]))) for i in range(300)]
    docs += [(1000 - i, "red ring, the ring") for i in range(90)]  # a class of copies
    docs += [(2000, None), (2001, ""), (2002, " .,\x7f"), (None, "red blue"), (5, "blue x1"), (5, "blue x1"), (3000, "the ring " * 200_000 + "red")]
    items = [(1, "The RED ring!"), (2, "42 x1 x1 blue"), (3, None), (4, ""), (5, "nowhere"), (2, "42 x1 x1 blue"), (6, "sch\xf6n 漢字 the"), (None, "red")]
    return docs, items


@pytest.mark.parametrize("cells, slice_", [(4 << 20, 1 << 20), (7, 64)])
def test_ranks_equal_brute_force(spark, monkeypatch, cells, slice_):
    monkeypatch.setattr(lexical, "BLOCK_CELLS", cells)
    monkeypatch.setattr(lexical, "BATCH_CELLS", 64)
    monkeypatch.setattr(lexical, "_SLICE", slice_)
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, "m") for x in docs], "doc_id long, text string, m int, bag string").repartition(4)
    q = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, score double")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(d, q, top=5).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted([r for i in items for r in brute(docs, [i], 5)], key=key)


def test_empty_tables(spark):
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.rank(d.limit(0), q).count() == lexical.rank(d, q.limit(0)).count() == lexical.rank(d.where("doc_id = 2000"), q).count() == 0


def test_sums_beyond_doubles_are_exact(spark):
    docs, items = [(1, "a b"), (2, "a c"), (3, "b")], [(1, "a b " * 400_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.rank(d, q).collect())) == brute(docs, items, 20)


def test_whole_tables_agree_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP11_SQL})").fetchall())
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op11_lexical_search(spark, folder).collect())
    assert got == want and len(want) > 500
