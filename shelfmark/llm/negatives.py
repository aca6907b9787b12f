"""Hard negatives by exact inner products in a residue number system.

Components are whole numbers. A product of matrices is taken modulo several small primes,
each in float32: residues are centred on 0 and so small that every sum of their products
stays below 2^24, where floats are exact. The Chinese remainder theorem puts the residues
together to the one signed number that they can stand for, as the primes' product is more
than twice the largest score.

Anchors go in blocks of bounded size against all rows, which stay where they are read. Of
each task's rows only the best of each anchor move, to windows that select among them:
first the positives, whose scores then bound each positive's negatives.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running_total, shared_folder, written

POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score, in hundredths, that a negative has at least and at most.
LOW, HIGH = 50, 95
STEP = 50
#: Anchors of a block, and rows that meet them at a time.
BLOCK, ROWS = 2048, 1024
_EXACT = 1 << 24
#: Columns of a product at most, and the largest score: a hundredfold must fit into a long.
_WIDTH, _MOST = 1024, 1 << 56


def primes_for(width: int, bound: int) -> list[int]:
    """Primes, the largest first, whose centred residues keep sums of ``width`` products
    below 2^24 and whose product is above twice the bound."""
    half = int((_EXACT / max(1, width)) ** 0.5)
    out, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound:
        while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
            p -= 1
        if p < 3:
            raise ValueError("no primes are left")
        out.append(p)
        product *= p
        p -= 1
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Centred on 0."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def combined(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these residues, digit by digit in mixed radix: digits are
    centred too, so that the sum is signed and never beyond half the primes' product."""
    out, radix = np.zeros(parts[0].shape, np.int64), 1
    for part, p in zip(parts, primes):
        digit = np.mod((part.astype(np.int64) - out % p) * pow(radix, -1, p), p)
        digit[digit > p // 2] -= p
        out += digit * radix
        radix *= p
    return out


@dataclass
class Product:
    """Exact inner products with the rows of one matrix (anchors by components)."""

    anchors: np.ndarray
    bound: int

    def __post_init__(self):
        width = self.anchors.shape[1]
        self.spans = [slice(a, min(a + _WIDTH, width)) for a in range(0, width, _WIDTH)]
        self.primes = primes_for(min(width, _WIDTH), self.bound)
        self.own = [residues(self.anchors, p) for p in self.primes]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anchors by rows."""
        parts = []
        for p, own in zip(self.primes, self.own):
            other = residues(rows, p)
            parts.append(sum(np.mod((own[:, s] @ other[:, s].T).astype(np.int64), p) for s in self.spans))
        return combined(parts, self.primes)


def prepared(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, v (whole components): rows that take part."""
    x = F.col(embedding)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("e", lambda e: F.floor(e * 256)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter ones end with zeros."""
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(np.append(0, ends))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


class _Nearest:
    """The best rows of each slot so far, by score and then by id."""

    def __init__(self, slots: int, most: int):
        self.most, self.cut = most, np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        every = [np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids))]
        order = np.lexsort((every[2], -every[1], every[0]))
        own = every[0][order]
        kept = order[np.arange(len(own)) - np.searchsorted(own, own) < self.most]
        self.slot, self.score, self.id = (x[kept] for x in every)
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.cut)) == self.most)
        self.cut[full] = self.score[np.searchsorted(self.slot, full, side="right") - 1]


def _found(rows: DataFrame, slots: int, most: int, product, candidates) -> DataFrame:
    """slot, id, score: each task's best rows of each slot. ``product`` makes what scores
    rows; ``candidates`` yields slots, rows and scores that pass the cuts."""

    def find(batches):
        near, own = _Nearest(slots, most), product()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
                scores = own.scores(_matrix(batch.column("v"), own.anchors.shape[1]))
                for slot, row, score in candidates(scores, ids, labels, near.cut):
                    near.add(slot, score, ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(near.slot), pa.array(near.id), pa.array(near.score)], names=["slot", "id", "score"])

    return rows.mapInArrow(find, "slot long, id long, score long")


def _first(df: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("id")))
    return df.withColumn("rank", place).where(F.col("rank") <= most)


def _mined(rows: DataFrame, anchors: list, width: int, bound: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """All triples of one block of anchors (rows with vec_id, label, v)."""
    spark = rows.sparkSession
    own_id, own_label = (np.array([a[c] for a in anchors], np.int64) for c in ("vec_id", "label"))
    matrix = np.zeros((len(anchors), width), np.int64)
    for i, a in enumerate(anchors):
        matrix[i, : len(a["v"])] = a["v"]
    held = spark.sparkContext.broadcast((matrix, own_id, own_label))  # BLOCK anchors at most

    def product():
        return Product(held.value[0], bound)

    def alike(scores, ids, labels, cut):
        _, own_id, own_label = held.value
        slot, row = np.nonzero((own_label[:, None] == labels) & (own_id[:, None] != ids) & (scores >= cut[:, None]))
        yield slot, row, scores[slot, row]

    best = _first(_found(rows, len(anchors), positives, product, alike), positives).select("slot", "id", "score", "rank").collect()
    slots = len(anchors) * positives
    goal, partner = np.zeros((len(anchors), positives), np.int64), np.zeros((len(anchors), positives), np.int64)
    there = np.zeros((len(anchors), positives), bool)
    for slot, key, score, place in best:  # ``positives`` of each anchor of the block
        goal[slot, place - 1], partner[slot, place - 1], there[slot, place - 1] = score, key, True
    bounds = spark.sparkContext.broadcast((goal, there))

    def unlike(scores, ids, labels, cut):
        goal, there = bounds.value
        other = held.value[2][:, None] != labels
        hundredfold, cut = scores * 100, cut.reshape(goal.shape)
        for j in range(positives):
            least = np.maximum(goal[:, j] * low, np.maximum(cut[:, j], -(1 << 56)) * 100)[:, None]
            ok = other & there[:, j, None] & (hundredfold >= least) & (hundredfold <= goal[:, j, None] * high)
            anchor, row = np.nonzero(ok)
            yield anchor * positives + j, row, scores[anchor, row]

    chosen = _first(_found(rows, slots, negatives, product, unlike), negatives)
    names = spark.createDataFrame(
        [(int(i * positives + j), int(own_id[i]), int(partner[i, j]), int(goal[i, j])) for i in range(len(anchors)) for j in range(positives) if there[i, j]],
        "slot long, anchor_id long, positive_id long, positive_score long",
    )
    joined = chosen.join(F.broadcast(names), "slot")  # ``positives`` rows of each anchor of the block
    return joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", step: int = STEP,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    row whose id is divisible by ``step`` and each of its best ``positives`` rows of the
    same label, the best ``negatives`` rows of other labels whose scores are from ``low``
    to ``high`` hundredths of the positive's.

    Rows without id, label or vector, or with a null or non-finite component, take no
    part. Shorter vectors count as if zeros followed. Rows of the anchor's own id are not
    its positives; repeated rows are rows of their own. Equal scores go by the smaller id.
    An empty table, no anchors, or anchors without positives or negatives give no rows.
    Vectors so long that a score times 100 may not fit into a long raise. Other columns are not
    read. The work is all rows for each block of anchors; no pair leaves its task."""
    spark = df.sparkSession
    rows = written(prepared(df, vec_id, embedding, label), shared_folder(spark, "vectors"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    width, most = rows.agg(F.max(F.size("v")), F.max(largest)).first()
    bound = (width or 0) * (most or 0) ** 2
    if bound > _MOST:
        raise ValueError(f"scores up to {bound} do not fit")
    anchors = running_total(checkpoint(rows.where(F.col("vec_id") % step == 0).withColumn("one", F.lit(1).cast("long"))), [F.asc("vec_id")], "one", "place")
    anchors = checkpoint(anchors.withColumn("block", F.floor(F.col("place") / BLOCK)))
    folder = shared_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_blocks = (anchors.agg(F.max("block")).first()[0] or 0) + 1
    for k in range(n_blocks):
        block = anchors.where(F.col("block") == k).select("vec_id", "label", "v").collect()  # BLOCK rows at most
        if block:
            _mined(rows, block, max(1, width), max(1, bound), positives, negatives, low, high).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if width is not None and anchors.limit(1).count() else spark.createDataFrame([], schema)


def op12_hard_negatives(spark, sf_dir):
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.arid = p.arid AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""
