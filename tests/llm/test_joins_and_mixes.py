import random
from fractions import Fraction

import pytest

from shelfmark.llm import mixing, ngram_join


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(rows, k, t):
    sets, label = brute_sets([r[1] for r in rows], k), list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * t.denominator >= len(a | b) * t.numerator:
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(rng, n):
    rows, words = [], [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 20, 60, 150]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
    return rows


@pytest.mark.parametrize("k, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, k, t):
    rng = random.Random(k)
    rows = near_copies(rng, 350)
    family = [f"f{i}" for i in range(120)]  # more than one group of near copies
    for i in range(150):
        copy = list(family)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "UPPER Case Words"), (5004, "upper case\nwords"), (5005, "é x"), (5006, "É x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, set_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_ids(df, k=k, threshold=t).collect()}
    assert got == brute_components(rows, k, t)


def test_long_texts_and_repeated_rows(spark):
    words = " ".join(f"word{i}" for i in range(400_000))  # beyond two segments
    rows = [(1, words), (2, words), (3, words + " more"), (4, "a b c d"), (4, "a b c d"), (4, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.component_ids(df).collect())
    assert got == [(1, 399_998, 1), (2, 399_998, 1), (3, 399_999, 1), (4, 2, 4), (4, 2, 4), (4, 2, 4)]
    kept = sorted(map(tuple, ngram_join.deduplicate(df).collect()))
    assert [r[0] for r in kept] == [1, 4, 4]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ngram_join.component_ids(df).count() == 0
    assert ngram_join.deduplicate(df).count() == 0
    assert mixing.assign(df).count() == 0
    assert mixing.mix(df).count() == 0


def test_targets_are_capped_and_shared_again(spark):
    rows = [(i, "w " * 10, "a") for i in range(4)] + [(100 + i, "w " * 10, "b") for i in range(90)] + [(300, "x", None), (301, None, "b"), (302, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.assign(df).collect()
    target = {r.source: r.target for r in plan}
    assert target["a"] == 120 and target[None] == 1 * target["b"] / 2 if target[None] < 3 else target[None] == 3
    assert abs(sum(target.values()) - 941) < 1e-6 and target["c"] == 0
    for s in ("a", "b"):
        assert abs(sum(r.taken for r in plan if r.source == s) - target[s]) <= 5
    assert all(r.taken <= 3 * r.size for r in plan)
    again = {(r.doc_id, r.taken) for r in mixing.assign(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in plan}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in plan)


def test_schedules_decide_the_order(spark):
    rows = [(i, "w " * 10, "a") for i in range(60)] + [(100 + i, "w " * 10, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.source for r in mixing.mix(df, weight=lambda r: r * 0 + 1).collect()]
    half = len(order) // 2
    assert order[:half].count("a") > 1.3 * order[half:].count("a")


def test_repeated_ids_are_mixed_as_planned(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [(i % 7 if i % 3 else None, words(5 + i % 4, f"w{i % 5}"), "ab"[i % 9 == 0], i) for i in range(90)]
    rows += [(3, words(6, "same"), "a", 1000 + i) for i in range(6)] + [(4, None, "a", 2000), (4, " ", None, 2001)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    planned, mixed = {}, {}
    for r in mixing.assign(df).collect():
        planned[r.doc_id, r.source, r["size"]] = planned.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    got = mixing.mix(df).collect()
    for r in got:
        key = r.doc_id, r.source, len(r.text.split())
        mixed[key] = mixed.get(key, 0) + 1
    assert mixed == {k: n for k, n in planned.items() if n}
    # Each row comes three times at most, and again alike.
    times = [sum(r["size"] == i for r in got) for i in {r["size"] for r in got}]
    assert max(times) <= mixing.MOST_REPEATS and all(r["size"] < 2000 for r in got)


def test_query_is_sorted_by_position(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.001"
    out = mixing.op8_mixing(spark, folder).withColumn("part", F.spark_partition_id()).collect()
    places = [r.position for r in sorted(out, key=lambda r: r.part) if r.position is not None]
    assert places == sorted(places) and all(r.last_position >= r.position for r in out if r.position is not None)


def test_repeated_rows_join_once(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f G"), (None, "a b c d e f g"), (1, "else"), (7, "a b c d e f x"), (7, "a b c d e f x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.component_ids(df, k=3, threshold=Fraction(3, 5)).collect())
    assert got == [(0, 5, 1), (1, 1, 1), (1, 5, 1), (1, 5, 1), (2, 5, 1), (7, 5, 1), (7, 5, 1)]


def test_a_passage_in_half_of_all_documents(spark):
    rng, passage = random.Random(9), " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{passage} {' '.join(f'w{rng.randrange(60)}' for _ in range(rng.choice([4, 9, 14])))}" if i % 2 else " ".join(f"x{rng.randrange(900)}" for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_ids(df, k=3, threshold=Fraction(9, 10)).collect()}
    assert got == brute_components(rows, 3, Fraction(9, 10))
