"""A factorisation machine for document quality.

Inputs are hashed words, structure statistics and one piece of metadata (the length in
characters). Each input has a weight and a short vector; the score adds the pairwise
products of the vectors. By the sum-of-squares identity those cost no more than the
inputs: half of (square of the sum less sum of the squares), per factor.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .ngram_join import _words

BUCKETS = 1 << 14
FACTORS = 6
#: Labelled rows that the model is fitted on, at most (chosen by a digest of the id).
MOST_LABELLED = 4000
EPOCHS = 12
_SYMBOLS = np.frombuffer(b"#*$%&|<>!", np.uint8)
STATISTICS = 10


def describe(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a text, and its statistics, scaled to about 0 to 1.
    Without words there are no buckets."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, _ = _words(raw.lower())
    buckets = np.unique(words % np.uint64(BUCKETS)).astype(np.int32)
    n = max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)
    statistics = np.array(
        [
            np.log1p(n) / 10,
            min(1.0, len(raw) / n / 20),
            min(1.0, seen[_SYMBOLS].sum() / n),
            seen[65:91].sum() / max(1, letters),
            seen[48:58].sum() / max(1, len(raw)),
            len(np.unique(words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            1 - len(np.unique(windows)) / max(1, len(windows)),
            min(1.0, (seen[46] + seen[44]) / n),
            np.log1p(len(text or "")) / 14,
        ],
        np.float32,
    )
    return buckets, statistics


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, buckets: list[np.ndarray], statistics: np.ndarray) -> np.ndarray:
        """Linear time in the number of inputs."""
        index, value, row = _flat(buckets, statistics)
        n = len(buckets)
        linear = np.bincount(row, self.weights[index] * value, n)
        pairs = np.zeros(n)
        for f in range(self.vectors.shape[1]):
            xv = self.vectors[index, f] * value
            pairs += np.bincount(row, xv, n) ** 2 - np.bincount(row, xv * xv, n)
        return self.bias + linear + pairs / 2

    def scores(self, buckets: list[np.ndarray], statistics: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(buckets, statistics), -30, 30)))


def _flat(buckets: list[np.ndarray], statistics: np.ndarray):
    """Inputs of all rows: place, value, row. The words of a row have length 1 together."""
    sizes = np.array([len(b) for b in buckets], np.int64)
    k = statistics.shape[1]
    index = np.concatenate([*buckets, np.tile(BUCKETS + np.arange(k), len(buckets))]).astype(np.int64)
    value = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes), statistics.ravel() * 2])
    row = np.concatenate([np.repeat(np.arange(len(buckets)), sizes), np.repeat(np.arange(len(buckets)), k)])
    return index, value, row


def train(buckets: list[np.ndarray], statistics: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Logistic loss, adaptive steps, both classes weighing the same in sum up to a
    factor of 2. Without rows, or with one class only, the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + statistics.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not len(labels) or labels.min() == labels.max():
        m.vectors[:] = 0
        return m
    heavy = np.where(labels == 0, min(2.0, share / (1 - share)), 1.0)
    g_bias, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            index, value, row = _flat([buckets[i] for i in part], statistics[part])
            n = len(part)
            xv = m.vectors[index] * value[:, None]
            sums = np.stack([np.bincount(row, xv[:, f], n) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (xv * xv).sum(1), n)
            margin = m.bias + np.bincount(row, m.weights[index] * value, n) + ((sums**2).sum(1) - squares) / 2
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * heavy[part] / n
            own, place = np.unique(index, return_inverse=True)
            step_w = np.bincount(place, slope[row] * value, len(own)) + 1e-5 * m.weights[own]
            each = (slope[row] * value)[:, None] * (sums[row] - xv)
            step_v = np.stack([np.bincount(place, each[:, f], len(own)) for f in range(FACTORS)], 1) + 1e-5 * m.vectors[own]
            g_bias += slope.sum() ** 2
            g_w[own] += step_w**2
            g_v[own] += step_v**2
            m.bias -= 0.2 * slope.sum() / np.sqrt(g_bias)
            m.weights[own] -= 0.2 * step_w / np.sqrt(g_w[own])
            m.vectors[own] -= 0.05 * step_v / np.sqrt(g_v[own])
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Machine:
    """Fits on at most ``most`` rows of ``labels`` (doc_id, label), those with the least
    digest of their id; both tables may hold more. Null labels and null ids are left out. Of
    documents that share an id one counts (that with the least inputs), and so the driver
    holds no more than ``most`` rows, a few kB each. Without rows a text's score is 0.5."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_l"), "_l", "label")
        .limit(most)
    )

    def inputs(batches):
        for batch in small_batches(batches, "text"):
            found = [describe(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([s.tobytes() for _, s in found], pa.binary()),
                ],
                names=["doc_id", "label", "buckets", "statistics"],
            )

    # At most ``most`` rows of two numbers.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_l")
    )
    got = rows.select("doc_id", "text", "label").mapInArrow(inputs, "doc_id long, label int, buckets binary, statistics binary")
    once = got.groupBy("doc_id", "label").agg(F.min(F.struct("buckets", "statistics")).alias("x")).select("doc_id", "label", "x.*")
    got = sorted(map(tuple, once.collect()))
    buckets = [np.frombuffer(r[2], np.int32) for r in got]
    statistics = np.array([np.frombuffer(r[3], np.float32) for r in got], np.float64).reshape(-1, STATISTICS)
    return train(buckets, statistics, np.array([r[1] for r in got], np.float64))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row. Null texts count as empty; they have a score too. Texts
    of any length are read whole; repeated rows have a score each; no rows give no rows;
    other columns of ``docs`` are not read, so their names may clash."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))

    def run(batches):
        m = Machine(*shared.value)
        for batch in small_batches(batches, "text", 2 << 20):
            found = [describe(t) for t in batch.column("text").to_pylist()]
            if found:
                scores = m.scores([b for b, _ in found], np.array([s for _, s in found], np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
