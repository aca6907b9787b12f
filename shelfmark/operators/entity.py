"""Entity resolution: candidate pairs within blocks, decisions, clusters, canonical names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


#: Characters that one whole number holds a bit for, with room for the carry of a sum.
_BITS = 61


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, a row of its table at a time.

    Where ``a`` has up to 61 characters a row is one whole number, whose zero bits mark the
    steps of the row (Hyyro, 2004); each character of ``b`` makes the next row by a sum.
    Longer texts keep the row as an array."""
    cut = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def in_bits(x, y):
        places = lambda c: F.aggregate(
            F.sequence(F.lit(0), F.size(x) - 1), F.lit(0).cast("long"), lambda m, i: m + F.when(F.get(x, i) == c, F.get(F.lit([1 << k for k in range(_BITS)]), i)).otherwise(0)
        )
        full = F.get(F.lit([(1 << k) - 1 for k in range(_BITS + 1)]), F.size(x))
        kinds = F.array_distinct(x)

        def rows(masks):
            def row(v, c):
                met = v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long")))
                return (v + met).bitwiseOR(v - met).bitwiseAND(full)

            return F.size(x) - F.bit_count(F.aggregate(y, full, row))

        return F.transform(F.array(F.map_from_arrays(kinds, F.transform(kinds, places))), rows)[0]

    def in_arrays(x, y):
        def row(last, c):
            # The row so far ends with the cell to the left; the row above has a 0 before it.
            cell = lambda acc, j: F.array_append(acc, F.when(F.get(y, j) == c, F.get(last, j) + 1).otherwise(F.greatest(F.get(last, j + 1), F.element_at(acc, -1))))
            return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(x, F.transform(F.sequence(F.lit(0), F.size(y)), lambda i: F.lit(0)), row), -1)

    parts = F.array(F.struct(cut(a).alias("x"), cut(b).alias("y")))
    short = F.length(a) <= _BITS
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(
        F.transform(parts, lambda s: F.when(short, in_bits(s["x"], s["y"])).otherwise(in_arrays(s["x"], s["y"])))[0]
    )


def indel_ratio(a: Column, b: Column) -> Column:
    """1 less the insertions and deletions between two texts over their joint length: twice
    the longest common subsequence over it; 1 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).when(a == b, 1.0).otherwise(common_length(a, b) * 2.0 / both)


def token_words(name: Column) -> Column:
    """Distinct words of a name, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The greatest of three indel ratios: shared words against these and one side's own,
    for either side, and both sides whole, all sorted. So word order, repeats and words
    that only one side has do not count; a side without words has 0 with any other. The
    first two need no subsequence, as one text begins with the other."""
    both = F.array_intersect(token_words(a), token_words(b))
    parts = F.struct(
        F.array_join(both, " ").alias("s"), F.array_join(F.array_except(token_words(a), token_words(b)), " ").alias("x"), F.array_join(F.array_except(token_words(b), token_words(a)), " ").alias("y")
    )

    def ratio(p):
        n, x, y = F.length(p["s"]), F.length(p["x"]), F.length(p["y"])
        gap = F.when(n > 0, 1).otherwise(0)
        left, right = n + F.when(x > 0, x + gap).otherwise(0), n + F.when(y > 0, y + gap).otherwise(0)
        # Shared words stand at the front of both, so they are common to every subsequence.
        whole = (n + gap + common_length(p["x"], p["y"])) * 2.0 / (left + right)
        of = lambda side: F.when(n > 0, n * 2.0 / (n + side)).otherwise(0.0)
        return F.when((n + x == 0) | (n + y == 0), 0.0).when((n > 0) & ((x == 0) | (y == 0)), 1.0).otherwise(F.greatest(whole, of(left), of(right)))

    return F.transform(F.array(parts), ratio)[0]


def _rarest_first(rows: DataFrame, block: str, item: str) -> DataFrame:
    """Adds ``df``: how many names of the block hold the item (counts meet, not names)."""
    return rows.join(rows.groupBy(block, item).agg(F.count("*").alias("df")), [block, item])


def token_set_pairs(df: DataFrame, block: str, key: str, name: str, least: float = 0.9) -> DataFrame:
    """block, a, b, name_a, name_b, ratio of all pairs of a block whose token-set ratio is
    ``least`` or more; ``key`` must be unique in its block. Two prefix filters make the
    candidates, so that a frequent word pairs nothing by itself, and miss none:

    * If the shared words against one side's own reach the ratio, that side lacks few: of
      its words, rarest first, those that together are longer than what it may lack have a
      shared one among them.
    * If both sides' own words do, an insertion or deletion breaks two pairs of neighbours
      within words at most on its own side and one on the other. So of the shorter side's
      distinct neighbour pairs, rarest first, one more than may break have one among them
      that the longer side has, whose length lies within the edits allowed. Names with too
      few of them meet by length alone."""
    words = token_words(F.col(name))
    n = df.select(block, F.col(key).alias("k"), F.col(name).alias("x"), words.alias("w")).where(F.size("w") > 0)
    n = n.withColumn("len", F.length(F.array_join("w", " ")))
    share = 2 * (1 - least) / least
    lacks = F.greatest(F.lit(0.0), (share * (F.col("len") - 1) - 1) / (1 + share) + 1e-9)
    each = checkpoint(_rarest_first(n.select(block, "k", "x", "len", F.explode("w").alias("item")), block, "item"))
    told = each.groupBy(block, "k", "x", "len").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    sums = F.aggregate(
        "items",
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("kept")),
        lambda acc, i: F.struct((acc["sum"] + F.length(i["item"])).alias("sum"), F.when(acc["sum"] <= lacks, F.array_append(acc["kept"], i["item"])).otherwise(acc["kept"]).alias("kept")),
        lambda acc: acc["kept"],
    )
    prefix = told.select(block, "k", F.explode(sums).alias("item"))
    by_word = prefix.join(each.select(block, "item", F.col("k").alias("l")), [block, "item"]).select(block, "k", "l")

    # Edits of two names of joint length s: (1 - least) * s; the longer has len * (2 - least) / least at most.
    longest = F.floor(F.col("len") * (2 - least) / least + 1e-9).cast("int")
    edits = F.floor((1 - least) * (F.col("len") + longest) + 1e-9)
    breaks = F.floor(edits * 1.5).cast("int")
    grams = F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2))))))
    n = n.withColumn("g", F.filter(grams, lambda g: F.length(g) == 2)).withColumns({"longest": longest, "breaks": breaks})
    few = F.size("g") <= F.col("breaks")
    pieces = checkpoint(_rarest_first(n.select(block, "k", "len", "longest", "breaks", F.explode("g").alias("item")), block, "item"))
    chosen = pieces.groupBy(block, "k", "len", "longest", "breaks").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items")).where(F.size("items") > F.col("breaks"))
    lengths = F.explode(F.sequence("len", "longest"))
    asked = chosen.select(block, "k", "longest", "len", F.explode(F.slice("items", F.lit(1), F.col("breaks") + 1)).alias("i")).select(block, "k", "i.item", lengths.alias("len"))
    by_gram = asked.join(pieces.select(block, "item", "len", F.col("k").alias("l")), [block, "item", "len"]).select(block, "k", "l")
    by_length = n.where(few).select(block, "k", lengths.alias("len")).join(n.select(block, "len", F.col("k").alias("l")), [block, "len"]).select(block, "k", "l")

    pairs = by_word.unionByName(by_gram).unionByName(by_length).where("k <> l")
    pairs = pairs.select(block, F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b")).distinct()
    of = lambda k, x: n.select(block, F.col("k").alias(k), F.col("x").alias(x))
    joined = pairs.join(of("a", "name_a"), [block, "a"]).join(of("b", "name_b"), [block, "b"])
    return joined.withColumn("ratio", token_set_ratio(F.col("name_a"), F.col("name_b"))).where(F.col("ratio") >= least - 1e-12).select(block, "a", "b", "name_a", "name_b", "ratio")


def close_pairs(df: DataFrame, block: str, key: str, name: str, share: int = 10) -> DataFrame:
    """Pairs of a block whose edit distance is at most one ``share``-th of the longer name
    (a similarity of 0.9 for 10), among few others: an equi-join on parts of names.

    A name of length n may differ by e = n / share edits, so one of its e + 1 even parts
    stands unchanged in any shorter name it is close to, shifted by e at most (Li, Deng,
    Wang and Feng, 2011). Longer names give their parts, shorter ones the pieces of their
    text at each such place; a common word alone pairs nothing."""
    length = F.length(name)
    edits = lambda n: F.floor(n / share).cast("int")
    start = lambda n, i: F.floor(i * n / (edits(n) + 1)).cast("int")
    part = lambda n, i, shift: F.struct(
        n.alias("n"), i.alias("i"), F.substring(F.col(name), start(n, i) + shift + 1, start(n, i + 1) - start(n, i)).alias("s")
    )
    own = F.transform(F.sequence(F.lit(0), edits(length)), lambda i: part(length, i, F.lit(0)))

    def places(n):
        shifts = F.sequence(-edits(n), edits(n))
        each = lambda i: F.transform(F.filter(shifts, lambda x: start(n, i) + x >= 0), lambda x: part(n, i, x))
        return F.flatten(F.transform(F.sequence(F.lit(0), edits(n)), each))

    longest = F.floor(length * share / (share - 1)).cast("int")
    sought = F.flatten(F.transform(F.sequence(length, longest), places))
    rows = df.where(length > 0)
    long_ = rows.select(block, F.col(key).alias("k"), F.col(name).alias("x"), F.explode(own).alias("_s"))
    short = rows.select(block, F.col(key).alias("l"), F.col(name).alias("y"), F.explode(F.array_distinct(sought)).alias("_s"))
    both = long_.join(short, [block, "_s"]).where((F.col("k") != F.col("l")) & (F.levenshtein("x", "y") * share <= F.greatest(F.length("x"), F.length("y"))))
    first = F.col("k") < F.col("l")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return both.select(block, pick("k", "l").alias("a"), pick("l", "k").alias("b"), pick("x", "y").alias("name_a"), pick("y", "x").alias("name_b")).distinct()


def decide(pairs: DataFrame, similar: Column, shared: Column, no_names: Column) -> DataFrame:
    """Merge if similar by 0.9 with a shared surname, or by 0.99 if a side has none."""
    first = (similar >= 0.9) & (shared >= 1)
    second = (similar >= 0.99) & no_names
    confidence = F.when(first, (similar + F.least(shared / 2, F.lit(1.0))) / 2).when(second, similar * 0.8).otherwise(0.0)
    return pairs.withColumn("merge", first | second).withColumn("confidence", confidence)


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """node, component: the smallest node that links reach. Smallest labels spread to
    neighbours and then along themselves; results of rounds are kept in the checkpoint
    folder, and rounds end when nothing changes."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = e.union(e.select("v", "u")).where("u <> v").distinct()
    kept = checkpoint(e)
    labels = checkpoint(kept.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = kept.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = checkpoint(step.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")))
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def canonical(members: DataFrame, cluster: str, name: str, count: str) -> DataFrame:
    """One row per cluster: the name with most rows (then the longest), members, total."""
    return members.groupBy(cluster).agg(
        F.max_by(name, F.struct(F.col(count), F.length(name), F.col(name))).alias("canonical"), F.count("*").alias("members"), F.sum(count).alias("total")
    )
