"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the training tokens and a weight schedule over training
time (0 to 1). The integral of its schedule says how many of its tokens the run has
asked for by a time; inverting it gives the time at which the token at a place in the
source's own sequence is due. Documents lie in that sequence in the order of a digest
of their id, the sequence repeats as often as the target asks (three times at most),
and the mix is the documents range-sorted by the time at which they are due.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running_total, word_count

#: No document is taken more often than this.
MOST_REPEATS = 3


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the rank of a source (from 0)."""
    return rank % 3 + 1


def tilted(rank: Column) -> tuple[Column, Column]:
    """Schedule weights at the start and the end of the run, linear between: every
    other source is dense early, the rest late."""
    early = rank % 2 == 0
    return F.when(early, 1.5).otherwise(0.5), F.when(early, 0.5).otherwise(1.5)


def source_targets(
    sized: DataFrame, source: str, weight: Callable[[Column], Column] = cyclic_weight, repeats: int = MOST_REPEATS
) -> DataFrame:
    """One row per source: size, target, rank by code point (null last), tokens of the
    sources before it. Targets are shares of all tokens by weight; none is above
    ``repeats`` times its source, and what is above goes to the others by weight until
    none is above. That ends where all uncapped sources have one amount per weight, so
    the level is found in closed form over the sources sorted by their cap per weight."""
    ranked = (
        sized.groupBy(F.col(source).alias("_source"))
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))) - 1)
        .withColumn("_weight", weight(F.col("_rank")).cast("double"))
        .withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    )
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level).withColumn(
        "_level", F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    )
    return leveled.select(
        "_source",
        "_rank",
        "source_size",
        F.least(F.col("_weight") * F.max("_level").over(everything), F.col("_cap")).alias("target"),
        F.coalesce(
            F.sum("source_size").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )


def due(place: Column, target: Column, start: Column, end: Column) -> Column:
    """The time by which a source's schedule has asked for ``place`` of its ``target``
    tokens: the inverse of (start t + (end - start) t^2 / 2) over its value at 1."""
    asked = place / target * (start + end) / 2
    tilt = end - start
    return F.when(tilt == 0, asked / start).otherwise((F.sqrt(start * start + tilt * asked * 2) - start) / tilt)


def assign(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Callable[[Column], Column] = cyclic_weight,
    schedule: Callable[[Column], tuple[Column, Column]] = tilted,
    repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies
    (how often the mix takes it), taken (words), position (time at which its first copy
    is due; null if it is not taken) and _place (tokens before it in its source).

    A copy is taken if its middle lies below the target, so a source's sum misses the
    target by half a document at most. Null texts and texts without words have size 0
    and are never taken; a null source is a source of its own, after all others.
    Repeated rows count as rows of their own; rows alike in id, source and text are told
    apart by nothing, and their places may be exchanged. Texts of any length are counted
    whole. Other columns are not read, so their names may clash. No rows give no rows."""
    sized = checkpoint(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_order"),
        )
    )
    placed = running_total(
        sized, [F.asc_nulls_last("source"), F.asc("_order"), F.asc("doc_id"), F.asc("size")], "size", "_all_before"
    )
    targets = source_targets(sized, "source", weight, repeats)
    rows = placed.join(targets, placed["source"].eqNullSafe(targets["_source"])).withColumn(
        "_place", F.col("_all_before") - F.col("_before")
    )
    copies = sum(
        (
            F.when(
                (F.col("size") > 0)
                & ((F.col("source_size") * k + F.col("_place")) * 2 + F.col("size") < F.col("target") * 2),
                1,
            ).otherwise(0)
            for k in range(repeats)
        ),
        F.lit(0),
    )
    start, end = schedule(F.col("_rank"))
    return rows.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, due(F.col("_place"), F.col("target"), start, end)).alias("position"),
        "_place",
        start.alias("_start"),
        end.alias("_end"),
    )


def _numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_mix_number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents in training order: the rows of ``docs``, each as often as its
    row of ``assign`` says, range-sorted by the time at which each copy is due. Rows that
    share id, source and size are told apart by a digest of their text, and those that
    share that too are alike; each takes one row of the plan, so repeated ids are taken
    as often as planned. Columns stay those of ``docs``; names that begin with _mix_ raise,
    as the work uses them. Null texts and texts without words are never taken; no rows give no rows."""
    if own := [c for c in docs.columns if c.lower().startswith("_mix_")]:
        raise ValueError(f"columns in use here: {own}")
    key = ["doc_id", "source", "size"]
    plan = assign(docs, doc_id, text, source, **how)
    values = ("source_size", "target", "copies", "_start", "_end", "_place")
    single = plan.groupBy(*key).agg(*[F.first(c).alias(c) for c in values], F.count("*").alias("rows"), F.max("copies").alias("_most"))
    single = single.where("_most > 0").drop("_most")
    named = single.select(*[F.col(c).alias(f"_mix_{c.strip('_')}") for c in single.columns])
    of_docs = [F.col(doc_id), F.col(source), F.col("_mix_words")]
    of_plan = [F.col(f"_mix_{c}") for c in key]
    joined = docs.withColumn("_mix_words", word_count(F.col(text))).join(
        named, of_docs[0].eqNullSafe(of_plan[0]) & of_docs[1].eqNullSafe(of_plan[1]) & (of_docs[2] == of_plan[2])
    )
    # Rows that share a key are numbered on both sides; the plan's row of that number holds.
    several = _numbered(joined.where("_mix_rows > 1"), [f"_mix_{c}" for c in key], [F.xxhash64(text)])
    several = several.drop(*[f"_mix_{c.strip('_')}" for c in values])
    repeated = single.where("rows > 1").select(*[F.col(c).alias(f"_mix_{c}") for c in key])
    shared = plan.join(repeated, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_mix_{c}")) for c in key]), "left_semi")
    shared = _numbered(shared, key, [F.col("_place")]).where("copies > 0")
    shared = shared.select(
        *[F.col(c).alias(f"_plan_{c.removeprefix('_mix_')}") for c in (*key, "_mix_number")], *[F.col(c).alias(f"_mix_{c.strip('_')}") for c in values]
    )
    same = reduce(lambda x, y: x & y, [F.col(f"_mix_{c}").eqNullSafe(F.col(f"_plan_{c}")) for c in (*key, "number")])
    several = several.join(shared, same)
    wanted = [*docs.columns, *[f"_mix_{c.strip('_')}" for c in values]]
    taken = joined.where("_mix_rows = 1").select(*wanted).unionByName(several.select(*wanted))
    copies = taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
    position = due(
        F.col("_mix_source_size") * F.col("_mix_copy") + F.col("_mix_place"),
        F.col("_mix_target"),
        F.col("_mix_start"),
        F.col("_mix_end"),
    )
    return (
        copies.withColumn("_mix_position", position)
        .repartitionByRange("_mix_position", doc_id)
        .sortWithinPartitions("_mix_position", doc_id)
        .select(*docs.columns)
    )


def op8_mixing(spark, sf_dir):
    """The plan of the mix over all documents, range-sorted by the position of the first
    copy; what the mix does not take comes last."""
    plan = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    last = due(F.col("source_size") * (F.col("copies") - 1) + F.col("_place"), F.col("target"), F.col("_start"), F.col("_end"))
    order = [F.asc_nulls_last("position"), F.asc("doc_id")]
    return (
        plan.withColumn("last_position", F.when(F.col("copies") > 0, last))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "source_size", "target", "taken", *[F.round(c, 6).alias(c) for c in ("position", "last_position")])
    )


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (
  SELECT *, (rk % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM r),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM w),
t AS (
  SELECT source, rk, source_size,
    least(weight * (SELECT max(level) FROM l WHERE level <= cap / weight), cap) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rk,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS place
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
      (place * 2 + size < target * 2)::INT + ((source_size + place) * 2 + size < target * 2)::INT
      + ((source_size * 2 + place) * 2 + size < target * 2)::INT END AS copies,
    CASE WHEN rk % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS a,
    CASE WHEN rk % 2 = 0 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS b FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round((sqrt(a * a + (b - a) * (place / target * (a + b) / 2) * 2) - a) / (b - a), 6) + 0.0 END AS position,
  CASE WHEN copies > 0 THEN round((sqrt(a * a + (b - a) * ((place + (copies - 1) * source_size) / target * (a + b) / 2) * 2) - a) / (b - a), 6) + 0.0 END AS last_position
FROM c"""
