"""Unsupervised detectors of several kinds, and their mean by weights that labels teach.

Each gives a row a score from 0 to 1, larger for odder rows. The isolation forest is fitted
on a bounded sample, as its method asks (Liu, Ting and Zhou, 2008: trees of 256 rows), and
becomes one Spark expression; the grid counts all rows by cell; the distance asks for the
medians and quartiles of all rows. All rows are scored by all three.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.money import min_max, quantiles, robust_scale
from shelfmark.shared import checkpoint

TREES, ROWS = 32, 256


def average_path(n: int) -> float:
    """Mean depth at which a search that fails ends in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Split:
    """Rows below the place go left. A leaf has a depth instead, with what its rows add."""

    column: int = -1
    place: float = 0.0
    left: Split | None = None
    right: Split | None = None
    depth: float = 0.0


def grown(rows: np.ndarray, rng: np.random.Generator, most: int, depth: int = 0) -> Split:
    """A tree that splits at random places until rows stand alone or it is ``most`` deep."""
    wide = np.flatnonzero(rows.min(axis=0) < rows.max(axis=0)) if len(rows) > 1 else []
    if depth >= most or not len(wide):
        return Split(depth=depth + average_path(len(rows)))
    c = int(rng.choice(wide))
    place = float(rng.uniform(rows[:, c].min(), rows[:, c].max()))
    below = rows[:, c] < place
    if below.all() or not below.any():
        return Split(depth=depth + average_path(len(rows)))
    return Split(c, place, grown(rows[below], rng, most, depth + 1), grown(rows[~below], rng, most, depth + 1))


def forest(df: DataFrame, columns: list[str], key: str, trees: int = TREES, rows: int = ROWS, seed: int = 7) -> list[Split]:
    """Trees over samples of ``rows`` rows each, the first by a digest of the key: at most
    trees * rows rows come to the driver, whatever the table holds, and reruns agree."""
    drawn = df.select(*columns, F.xxhash64(key, F.lit(seed)).alias("_h")).orderBy("_h", *columns).limit(trees * rows).collect()
    data = np.array([[float(r[c]) for c in columns] for r in drawn], float).reshape(len(drawn), len(columns))
    rng = np.random.default_rng(seed)
    parts = [data[i::trees] for i in range(trees) if len(data[i::trees])]
    return [grown(p, rng, max(1, math.ceil(math.log2(max(2, len(p)))))) for p in parts]


def depth_in(tree: Split, columns: list[str]) -> Column:
    """Depth at which a row ends, as a chain of conditions."""
    if tree.column < 0:
        return F.lit(float(tree.depth))
    return F.when(F.col(columns[tree.column]) < tree.place, depth_in(tree.left, columns)).otherwise(depth_in(tree.right, columns))


def isolation(trees: list[Split], columns: list[str], rows: int = ROWS) -> Column:
    """2 to the power of minus the mean depth over the depth of a random tree."""
    if not trees:
        return F.lit(0.5)
    mean = reduce(lambda a, b: a + b, [depth_in(t, columns) for t in trees]) / float(len(trees))
    return F.pow(F.lit(2.0), -mean / max(average_path(rows), 1e-9))


def grid_density(df: DataFrame, columns: list[str], out: str, cells: int = 20) -> DataFrame:
    """Adds minus the log of the rows in the row's cell and its half share of those beside it
    along each axis: cells are even parts of each column's range. Rows become counts of
    cells before anything moves."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("z", F.max))])
    joined = df.join(F.broadcast(bounds))  # one row
    step = lambda c: F.nullif((F.col(f"_z_{c}") - F.col(f"_a_{c}")) / cells, F.lit(0.0))
    cell = lambda c: F.least(F.floor(F.coalesce((F.col(c) - F.col(f"_a_{c}")) / step(c), F.lit(0.0))), F.lit(cells - 1)).cast("int")
    placed = checkpoint(joined.select(*df.columns, *[cell(c).alias(f"_g_{c}") for c in columns]))
    axes = [f"_g_{c}" for c in columns]
    counts = placed.groupBy(*axes).agg(F.count("*").alias("_n"))
    spread = counts.select(F.explode(F.array(
        F.struct(*axes, F.col("_n").cast("double").alias("w")),
        *[F.struct(*[(F.col(a) + (d if a == b else 0)).alias(a) for a in axes], (F.col("_n") * 0.5).alias("w")) for b in axes for d in (-1, 1)],
    )).alias("s")).select("s.*")
    dense = spread.groupBy(*axes).agg(F.sum("w").alias("_w"))
    return placed.join(dense, axes).withColumn(out, -F.log("_w")).drop("_w", *axes)


def detected(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """df and s_forest, s_grid, s_distance, each from 0 to 1. Columns are scaled by their
    medians and quartiles first; they must not be null."""
    scaled = checkpoint(robust_scale(df.withColumns({f"_x_{c}": F.col(c) for c in columns}), [f"_x_{c}" for c in columns]))
    xs = [f"_x_{c}" for c in columns]
    trees = forest(scaled, xs, key)
    far = F.sqrt(reduce(lambda a, b: a + b, [F.col(x) * F.col(x) for x in xs]))
    rows = grid_density(scaled, xs, "s_grid").withColumn("s_forest", isolation(trees, xs)).withColumn("s_distance", far)
    return min_max(checkpoint(rows.drop(*xs)), ["s_forest", "s_grid", "s_distance"])


def auc(df: DataFrame, score: str, label: str) -> float | None:
    """Pairs of a labelled 1 and a labelled 0 that the score ranks right, ties by half;
    nothing where one of the two lacks. Ranks are sums over distinct scores."""
    by = checkpoint(df.where(F.col(label).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).withColumn("k", F.lit(0)))
    from shelfmark.operators.scans import running_sum

    below = running_sum(by, ["k"], [score], F.col("n"), "below")
    won, p, n = below.agg(F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0)), F.sum("p"), F.sum("n")).first()
    return won / (p * n) if p and n else None


def weights(df: DataFrame, scores: list[str], label: str) -> dict[str, float]:
    """Each detector by how far it is above chance on the labelled rows; even weights where
    labels say nothing, or none is above chance."""
    found = [auc(df, s, label) for s in scores]
    above = [max(0.0, (a or 0.5) - 0.5) for a in found]
    total = sum(above)
    return {s: a / total if total else 1 / len(scores) for s, a in zip(scores, above)}


def consensus(df: DataFrame, columns: list[str], key: str, label: str) -> tuple[DataFrame, dict[str, float]]:
    """df with the scores and ``score``, their mean by learnt weights; and the weights."""
    rows = checkpoint(detected(df, columns, key))
    names = ["s_forest", "s_grid", "s_distance"]
    learnt = weights(rows, names, label)
    return rows.withColumn("score", reduce(lambda a, b: a + b, [F.col(n) * learnt[n] for n in names])), learnt
