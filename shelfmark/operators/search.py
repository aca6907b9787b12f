"""Faceted search: filters that must hold, facets that filter or score, and ranking."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.boolsearch import scoring_terms
from shelfmark.shared import checkpoint


@dataclass
class Facets:
    """Hard predicates always filter. Soft ones filter in strict mode; in relevance mode
    each adds its weight where it holds."""

    hard: list[Column] = field(default_factory=list)
    soft: list[tuple[Column, float]] = field(default_factory=list)

    def must(self, predicate: Column) -> Facets:
        self.hard.append(predicate)
        return self

    def wish(self, predicate: Column, weight: float = 1.0) -> Facets:
        self.soft.append((predicate, weight))
        return self

    def score(self) -> Column:
        parts = [F.when(p, float(w)).otherwise(0.0) for p, w in self.soft]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def search(df: DataFrame, facets: Facets, relevance: bool, name: str, key: str) -> DataFrame:
    """Strict: the rows for which all predicates hold, with score 0. Relevance: rows that
    pass the hard ones, with a score above 0; order them by score, name and key."""
    hard = reduce(lambda a, b: a & b, facets.hard, F.lit(True))
    if relevance:
        return df.where(hard).withColumn("score", facets.score()).where("score > 0")
    soft = reduce(lambda a, b: a & b, [p for p, _ in facets.soft], F.lit(True))
    return df.where(hard & soft).withColumn("score", F.lit(0.0))


def ranked(df: DataFrame, order: list[Column], out: str = "rk", first: int = 1, last: int | None = None) -> DataFrame:
    """Rows ``first`` to ``last`` in a total order, with their rank. The page is taken by
    a distributed top-k before it is numbered, so only its rows meet in one task."""
    page = df.orderBy(*order).limit(last) if last is not None else df
    rank = F.row_number().over(Window.orderBy(*order))
    return page.withColumn(out, rank).where(F.col(out) >= first)


def position_decay(array: Column, query: str) -> Column:
    """Sum over elements (place i from 1) of the grades of all scoring terms, times 5/i.
    A grade is 1 for equality, 0.7 for a prefix term (``x*``), 0.4 for other matches."""
    terms = scoring_terms(query)

    def grade(element: Column) -> Column:
        low = F.lower(element)
        parts = []
        for t in terms:
            text = t.text.lower()
            if t.exact:
                parts.append(F.when(low == text, 1.0).otherwise(0.0))
            elif text.endswith("*") and "*" not in text[:-1] and "?" not in text:
                parts.append(F.when(low.startswith(text[:-1]), 0.7).otherwise(0.0))
            elif "*" in text or "?" in text:
                from shelfmark.operators.boolsearch import wildcard_regex

                parts.append(F.when(element.rlike(wildcard_regex(t.text)), 0.4).otherwise(0.0))
            else:
                parts.append(F.when(low == text, 1.0).when(low.contains(text), 0.4).otherwise(0.0))
        return reduce(lambda a, b: a + b, parts)

    graded = F.transform(array, lambda x, i: grade(x) * 5.0 / (i + 1))
    return F.aggregate(graded, F.lit(0.0), lambda a, x: a + x)


def ordinal_closeness(value: Column, scale: list[str], target: str) -> Column:
    """1, 0.5 or 0.2 for a distance of 0, 1 or 2 on the scale, else 0; unknown values 0;
    an unknown target counts as the middle one."""
    at = scale.index(target) if target in scale else (len(scale) - 1) // 2
    place = reduce(lambda c, i: c.when(value == scale[i], i), range(1, len(scale)), F.when(value == scale[0], 0))
    distance = F.abs(place - at)
    return F.when(distance == 0, 1.0).when(distance == 1, 0.5).when(distance == 2, 0.2).otherwise(0.0)


def diversified(df: DataFrame, owner: str, order: list[Column], most: int, k: int) -> DataFrame:
    """The best k with at most ``most`` per owner first, filled up by rank."""
    per_owner = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    staged = df.withColumn("_stage", F.when(per_owner <= most, 0).otherwise(1))
    return ranked(staged, [F.asc("_stage"), *order], last=k).drop("_stage")


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that have a term, a lower-case run of letters a-z
    (Robertson and Zaragoza, 2009). Each text is read once, by native counts, and becomes
    a row of numbers that statistics and scores both come from; documents without words
    count for the mean length."""
    wanted = list(dict.fromkeys(terms))
    low = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    has = lambda t: F.when(F.col("_t").contains(t), F.regexp_count("_t", F.lit(f"(?<![a-z]){t}(?![a-z])"))).otherwise(0)
    counts = checkpoint(low.select(key, F.regexp_count("_t", F.lit("[a-z]+")).alias("_len"), *[has(t).alias(f"_tf{i}") for i, t in enumerate(wanted)]))
    stats = counts.agg(F.count("*").alias("_n"), F.avg(F.col("_len").cast("double")).alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    # One row of statistics.
    joined = counts.where(F.greatest(F.lit(0), *[F.col(f"_tf{i}") for i in range(len(wanted))]) > 0).join(F.broadcast(stats))

    def part(i):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(F.lit(1.0) + (F.col("_n") - df + 0.5) / (df + 0.5))
        norm = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
        return F.when(tf > 0, idf * norm).otherwise(0.0)

    return joined.select(key, reduce(lambda x, y: x + y, [part(i) for i in range(len(wanted))]).alias("score"))


def words(text: Column) -> Column:
    """Lower-case runs of letters a-z."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda x: x != "")
