"""Which texts contain which terms, as a join of two tables.

Terms are indexed by one of their trigrams, the one that fewest texts have; a text meets
those terms whose trigram it has, and an exact test follows. So a frequent trigram pairs
nothing unless a term has no rarer one. Terms of one or two characters are their own index.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import checkpoint


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters. Characters are told apart once, and runs are
    joined from them, so a long text takes no more for each than a short one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def runs(c):
        out = c
        for k in range(1, n):
            size = F.greatest(F.size(c) - k, F.lit(0))
            out = F.zip_with(F.slice(out, F.lit(1), size), F.slice(c, F.lit(k + 1), size), lambda x, y: F.concat(x, y))
        return F.array_distinct(out)

    return F.transform(F.array(chars), runs)[0]


def substring_join(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """key, term: every text with every distinct term that it contains (case counts; fold
    both before, if it should not). Null texts contain nothing, null and empty terms are in
    none. ``key`` must be unique; columns of other names are not read."""
    t = checkpoint(terms.select(F.col(term).alias("term")).where("term <> ''").distinct())
    own = checkpoint(texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL"))
    short = F.when(F.length("term") < 3, F.array("term"))
    choices = t.select("term", F.explode(F.coalesce(short, grams(F.col("term"), 3))).alias("gram"))
    sizes = sorted(r[0] for r in t.select(F.least(F.length("term"), F.lit(3))).distinct().collect())  # 1, 2 or 3
    every = F.concat(*[grams(F.col("text"), n) for n in sizes or [3]])
    held = checkpoint(own.select("key", F.explode(every).alias("gram")).join(choices.select("gram").distinct(), "gram", "left_semi"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A trigram that no text has keeps its term from every text.
    rarest = choices.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = held.join(rarest, "gram").select("key", "term")
    exact = met.where(F.length("term") > 3).join(own, "key").where(F.col("text").contains(F.col("term"))).select("key", "term")
    return met.where(F.length("term") <= 3).unionByName(exact).withColumnsRenamed({"key": key, "term": term})
