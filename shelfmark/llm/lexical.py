"""Ranked lexical search for a set of queries, by classes of equal bags.

Queries go in blocks of bounded size. For the vocabulary of a block each document becomes
its bag, the vocabulary's terms with their frequencies, and all else of its text is left
behind. Statistics are counted over all documents. A score hangs on nothing but the bag
and m, the scaled length, so documents are hashed by the two, those of one hash compared
in full, and each class of equals is scored once, all classes of a batch against all
queries of the block in one product of matrices. Equal scores rank by ascending doc_id,
so a class enters a top k with its k smallest members at most, and of each task's classes
the best k, by score and first member, can be among the best of all.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, written

TOP = 20
#: A block of queries: its terms, the bytes of its terms, and terms times queries (one
#: query alone may go beyond the last two).
BLOCK_TERMS, BLOCK_BYTES, BLOCK_CELLS = 60_000, 4 << 20, 4 << 20
#: Cells of a batch's matrix of classes and terms.
BATCH_CELLS = 4 << 20
_SLICE = 1 << 20
#: A-Z in lower case; all that is no digit, letter or byte of a character beyond ASCII is blank.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists; long texts are cut between terms."""
    at = 0
    while at < len(text):
        part = text[at : at + _SLICE].translate(_PLAIN)
        at += len(part)
        while at < len(text) and not part.endswith(b" "):  # the term may go on
            more = text[at : at + _SLICE].translate(_PLAIN)
            end = more.find(b" ")
            part += more if end < 0 else more[: end + 1]
            at += len(more) if end < 0 else end + 1
        yield part.split()


@dataclass
class Block:
    """Queries: their ids, and for each the frequencies of its terms by number."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list[int | None] = field(default_factory=list)
    wanted: list[dict[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, key: int | None, counts: Counter) -> None:
        for t in counts:
            if t not in self.vocabulary:
                self.vocabulary[t] = len(self.vocabulary)
                self.size += len(t)
        self.ids.append(key)
        self.wanted.append({self.vocabulary[t]: k for t, k in counts.items()})

    def full(self, counts: Counter) -> bool:
        new = [t for t in counts if t not in self.vocabulary]
        n = len(self.vocabulary) + len(new)
        return bool(self.ids) and (n > BLOCK_TERMS or self.size + sum(map(len, new)) > BLOCK_BYTES or n * (len(self.ids) + 1) > BLOCK_CELLS)


def blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """Queries come to the driver a partition at a time and go on in blocks."""
    block = Block()
    for key, raw in queries.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        counts: Counter = Counter()
        for part in terms((raw or "").encode("utf-8", "surrogatepass")):
            counts.update(part)
        if block.full(counts):
            yield block
            block = Block()
        if counts:
            block.add(key, counts)
    if block.ids:
        yield block


def _bags(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), bag: numbers of the vocabulary's terms in order
    and then their frequencies, 32 bits each."""

    def restrict(batches):
        number = vocabulary.get
        for batch in small_batches(batches, "text"):
            n, bags = [], []
            for raw in _raw(batch.column("text")):
                counts: Counter = Counter()
                held = 0
                for part in terms(raw or b""):
                    held += len(part)
                    counts.update(map(number, part))
                counts.pop(None, None)
                flat = np.array(sorted(counts.items()), "<u4").T
                n.append(held)
                bags.append(flat.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(restrict, "doc_id long, n long, bag binary")


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _frequencies(bags: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: counts per task, summed by Spark."""

    def count(batches):
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                flat = np.frombuffer(bag, "<u4")
                held[flat[: len(flat) // 2]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in bags.select("bag").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # a row per term of the block
        out[term] = df
    return out


def _classes(bags: DataFrame, n_docs: int, n_all: int, top: int) -> DataFrame:
    """m, bag, members: the ``top`` smallest ids of each class of equal bags and m. Rows
    meet by their hash and are told apart by their whole bags; each task sends on no more
    than ``top`` rows of a class."""
    m = F.expr(f"75 + CAST(n * CAST({25 * n_docs} AS DECIMAL(25, 0)) div {n_all} AS BIGINT)")
    keyed = bags.where("length(bag) > 0 AND doc_id IS NOT NULL").select("doc_id", m.alias("m"), "bag")
    keyed = keyed.withColumn("digest", F.xxhash64("bag", "m"))
    key = ["digest", "m", "bag"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    first = keyed.withColumn("r", rank).where(F.col("r") <= top)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).select("m", "bag", "members")


class _Best:
    """The best ``top`` classes of each query so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.cut = top, np.ones(n_items, np.int64)
        self.item, self.score, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.members: np.ndarray = np.zeros(0, object)

    def add(self, scores: np.ndarray, first: np.ndarray, members: np.ndarray) -> None:
        """``scores``: classes by queries."""
        row, item = np.nonzero(scores >= self.cut)
        if not len(row):
            return
        every = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.first, first[row]), (self.members, members[row]))]
        order = np.lexsort((every[2], -every[1], every[0]))
        own = every[0][order]
        start = np.searchsorted(own, own)
        kept = order[np.arange(len(own)) - start < self.top]
        self.item, self.score, self.first, self.members = (x[kept] for x in every)
        last = np.flatnonzero(np.bincount(self.item, minlength=len(self.cut)) == self.top)
        self.cut[last] = self.score[np.searchsorted(self.item, last, side="right") - 1]


def _scored(classes: DataFrame, block: Block, weights: np.ndarray, top: int) -> DataFrame:
    """item, item_id, score, members of the best classes of each task."""
    n_terms, n_items = len(block.vocabulary), len(block.ids)
    ids, wanted = block.ids, block.wanted
    most = max(sum(k * int(weights[t]) for t, k in q.items()) for q in wanted) * 10**6
    kind = np.float64 if most < 1 << 53 else np.int64  # doubles hold such sums exactly

    def score(batches):
        asked = np.zeros((n_terms, n_items), kind)
        for i, q in enumerate(wanted):
            asked[list(q), i] = list(q.values())
        best, rows = _Best(n_items, top), max(1, BATCH_CELLS // n_terms)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                bags = [np.frombuffer(b, "<u4") for b in batch.column("bag").to_pylist()]
                sizes = np.array([len(b) // 2 for b in bags])
                row = np.repeat(np.arange(len(bags)), sizes)
                term = np.concatenate([b[: len(b) // 2] for b in bags])
                tf = np.concatenate([b[len(b) // 2 :] for b in bags]).astype(np.int64)
                m = batch.column("m").to_numpy()[row]
                part = np.zeros((len(bags), n_terms), kind)
                part[row, term] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                members = np.empty(len(bags), object)
                members[:] = batch.column("members").to_pylist()
                best.add((part @ asked).astype(np.int64), np.array([x[0] for x in members], np.int64), members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array([ids[i] for i in best.item], pa.int64()), pa.array(best.score), pa.array(best.members.tolist(), pa.list_(pa.int64()))],
            names=["item", "item_id", "score", "members"],
        )

    return classes.mapInArrow(score, "item long, item_id long, score long, members array<long>")


def rank(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each query row with a
    score above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms; a query without terms, or whose terms no document
    holds, has no rows. A document row without an id counts in the statistics and is not
    ranked; rows of one id are documents of their own, and so are query rows of one id.
    Empty tables give no rows. Other columns are not read. Each block of queries reads the
    texts once; texts do not move, bags do, once."""
    out, spark = None, docs.sparkSession
    for block in blocks(queries, item_id, query):
        bags = written(_bags(docs, doc_id, text, block.vocabulary), shared_folder(spark, "bags"))
        n_docs, n_all = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        held = _frequencies(bags, len(block.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        scored = _scored(_classes(bags, n_docs, n_all, top), block, weights, top)
        each = scored.select("item", "item_id", "score", F.explode("members").alias("doc_id"))
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
        found = each.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_lexical_search(spark, sf_dir):
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(@LOW, '@TERM') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
x AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM x GROUP BY term), s),
q AS (SELECT iid, item_id, term, count(*) AS k FROM (
  SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(@LOW, '@TERM')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
m AS (SELECT rid, doc_id, 75 + (25 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT iid, item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN x USING (term) JOIN m USING (rid) GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY rank <= 20""".replace("@LOW", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("@TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
