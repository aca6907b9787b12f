"""Full-text search by stored postings.

An index is a folder of segments and a manifest that lists them. A segment deals its
documents into ranges of some SPAN each, and holds for every term and range one block: the
documents with the term's frequency in each field and their lengths, and, in columns of
their own, their number, the largest frequency and the smallest length. Blocks lie in
partitions by the term's bucket, sorted by term, so that a search reads its terms' buckets
and of these the row groups that hold the terms.

Changed documents become a new segment. What they replace stays where it is: the keys go
to a list that searches leave out, and the terms of the old versions, kept by key, to a
list that document frequencies are lessened by. So scores are those of an index built anew.

A search bounds each range by its blocks' headers, scores the most promising ranges first,
and opens of the others only those whose bound reaches the last of the best so far
(block-max pruning: Ding and Suel, 2011).
"""
from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.shared import new_folder
from shelfmark.sources.manifest import Manifest

SPAN = 1024
#: Ranges whose blocks of a bucket share a file.
RANGES = 256
#: Ranges that are scored first, to learn what the others must reach.
PROBED = 16


@dataclass
class Index:
    """``fields``: columns of text, or arrays of it, that are searched as one document.
    ``buckets``: parts that terms and keys are dealt to; as many as make a part some
    hundred megabytes, thousands for a large corpus. It must stay as it is."""

    spark: SparkSession
    folder: str
    key: str
    fields: list[str]
    buckets: int = 16

    def __post_init__(self):
        self.manifest = Manifest(self.spark, self.folder)
        self.reopen()

    def reopen(self) -> Index:
        """As the newest manifest has it."""
        self.number, content = self.manifest.newest()
        self.segments: list[dict] = content.get("segments", [])
        return self

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _put(self, segments: list[dict]) -> Index:
        self.manifest.put(self.number + 1, {"segments": segments})
        self.number, self.segments = self.number + 1, segments
        return self

    def _postings(self, docs: DataFrame) -> DataFrame:
        """key, len, distinct terms with a space between, and their frequencies in each field,
        term after term; a row per document. Each document is counted where it is read."""
        kind = docs.schema[self.key].dataType
        texts = [F.array_join(f, " ") if docs.schema[f].dataType.typeName() == "array" else F.col(f) for f in self.fields]
        rows = docs.select(F.col(self.key).alias("key"), F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in texts]).alias("t"))
        letters = bytes(c if 97 <= c <= 122 else 32 for c in range(256))

        def count(batches):
            for batch in batches:
                # Few texts at a time are Python objects.
                for start in range(0, batch.num_rows, 256):
                    few = batch.slice(start, 256)
                    lens, terms, tfs = [], [], []
                    for fields in few.column("t").to_pylist():
                        own = [Counter(t.encode().translate(letters).split()) for t in fields]
                        held = list(own[0]) if len(own) == 1 else list(dict.fromkeys(chain.from_iterable(own)))
                        lens.append(sum(c.total() for c in own))
                        terms.append(b" ".join(held).decode())
                        tfs.append(list(own[0].values()) if len(own) == 1 else [c[t] for t in held for c in own])
                    yield pa.RecordBatch.from_arrays([few.column("key"), pa.array(lens, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.list_(pa.int32()))], names=["key", "len", "terms", "tfs"])

        return rows.mapInArrow(count, f"key {kind.simpleString()}, len long, terms string, tfs array<int>")

    def _blocks(self, forward: DataFrame, ranges: int) -> DataFrame:
        """The block of every term and range, made range by range: each is some SPAN documents."""
        n, kind = len(self.fields), forward.schema["key"].dataType.simpleString()

        def inverted(table):
            table = table.combine_chunks()
            keys, lens, texts, counts = (table.column(c).chunk(0) for c in ("key", "len", "terms", "tfs"))
            terms = pc.split_pattern(texts, " ")
            doc = np.repeat(np.arange(len(keys)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            codes = terms.flatten().dictionary_encode()
            at = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(codes.dictionary)))
            starts = np.concatenate([[0], ends[:-1]])
            tfs = counts.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[order]
            doc = doc[order]
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1) * n, pa.int32()), pa.array(tfs.reshape(-1), pa.int32()))
            posts = pa.StructArray.from_arrays([keys.take(pa.array(doc)), lens.take(pa.array(doc)), each], names=["key", "len", "tfs"])
            docs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)), pa.int32()), posts)
            number = table.column("range").chunk(0).take(pa.array(np.zeros(len(ends), int)))
            columns = [codes.dictionary, number, pa.array(ends - starts, pa.int32()), pa.array(np.maximum.reduceat(tfs.sum(axis=1), starts), pa.int32()), pa.array(np.minimum.reduceat(lens.to_numpy()[doc], starts), pa.int64()), docs]
            return pa.Table.from_arrays(columns, names=["term", "range", "n", "max_tf", "min_len", "docs"])

        dealt = forward.where("terms <> ''").select("key", "len", "terms", "tfs", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("range"))
        return dealt.groupBy("range").applyInArrow(inverted, f"term string, range int, n int, max_tf int, min_len long, docs array<struct<key:{kind},len:bigint,tfs:array<int>>>")

    def _write(self, docs: DataFrame, number: int, replaced: DataFrame | None) -> dict:
        """One segment; its entry of the manifest."""
        home = f"{self.folder}/segment-{number}-{new_folder(self.spark, 's').rsplit('-', 1)[1]}"
        self._postings(docs).withColumn("kb", self._bucket(F.col("key"))).write.partitionBy("kb").parquet(f"{home}/forward")
        forward = self.spark.read.parquet(f"{home}/forward")
        n_docs, n_words = forward.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        ranges = max(1, math.ceil(n_docs / SPAN))
        # A file holds the terms of a bucket in some ranges; ranges are even, so files of a bucket are.
        groups = math.ceil(ranges / RANGES)
        blocks = self._blocks(forward, ranges).withColumn("bucket", self._bucket(F.col("term")))
        file = F.col("bucket") * groups + F.pmod(F.col("range"), F.lit(groups))
        blocks.repartitionById(self.buckets * groups, file.cast("int")).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{home}/blocks")
        entry = {"home": home, "docs": n_docs, "words": n_words}
        if replaced is not None:
            old = self.forward(replaced).select("key", "len", "terms")
            old.write.parquet(f"{home}/old")
            old = self.spark.read.parquet(f"{home}/old")
            gone, less = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            replaced.select("key").distinct().write.parquet(f"{home}/replaced")
            old.select(F.explode(F.split("terms", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n")).withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{home}/dropped")
            entry |= {"docs": n_docs - gone, "words": n_words - less, "replaces": True}
        return entry

    def forward(self, keys: DataFrame | None = None) -> DataFrame:
        """key, len, terms, tfs of every document that no later segment replaces; those of
        ``keys`` (a column key) only, from their buckets, if given."""
        wanted = None if keys is None else keys.select("key").distinct().withColumn("kb", self._bucket(F.col("key")))
        parts = []
        for i, s in enumerate(self.segments):
            own = self.spark.read.parquet(f"{s['home']}/forward")
            if wanted is not None:
                own = own.join(wanted, ["key", "kb"], "left_semi")
            for later in self.segments[i + 1 :]:
                own = own.join(self.spark.read.parquet(f"{later['home']}/replaced"), "key", "left_anti")
            parts.append(own.select("key", "len", "terms", "tfs"))
        return reduce(DataFrame.unionByName, parts)

    def build(self, docs: DataFrame) -> Index:
        """Everything anew. Null texts have no words; keys must be unique."""
        return self._put([self._write(docs, self.number + 1, None)])

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> Index:
        """Documents that are new or replace those of their keys, and keys that go."""
        keys = changed.select(F.col(self.key).alias("key"))
        if deleted is not None:
            keys = keys.unionByName(deleted.select(F.col(self.key).alias("key")))
        return self._put([*self.segments, self._write(changed, self.number + 1, keys)])

    def _segments(self, table: str, terms: list[str]) -> DataFrame | None:
        """Rows of the terms' buckets in all segments, with the segment's place."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t"))).distinct().collect()]
        parts = [
            self.spark.read.parquet(f"{s['home']}/{table}").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).withColumn("segment", F.lit(i))
            for i, s in enumerate(self.segments)
            if table == "blocks" or s.get("replaces")
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def statistics(self, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """Documents, their mean length, and the document frequencies of terms."""
        n, total = sum(s["docs"] for s in self.segments), sum(s["words"] for s in self.segments)
        held = self._segments("blocks", terms).groupBy("term").agg(F.sum("n").alias("n"))
        less = self._segments("dropped", terms)
        if less is not None:
            held = held.unionByName(less.groupBy("term").agg((-F.sum("n")).alias("n")))
        df = dict(held.groupBy("term").agg(F.sum("n")).collect())  # a row per term
        return n, total / n if n else 0.0, {t: df.get(t, 0) for t in terms}

    def _live(self, scored: DataFrame) -> DataFrame:
        """Without the documents that a later segment replaces."""
        for i, s in enumerate(self.segments):
            if s.get("replaces"):
                gone = self.spark.read.parquet(f"{s['home']}/replaced").select(F.col("key").alias("_gone"))
                scored = scored.join(gone, (F.col("key") == F.col("_gone")) & (F.col("segment") < i), "left_anti")
        return scored

    def scores(self, terms: list[str], k1: float = 1.2, b: float = 0.75, fields: list[str] | None = None, ranges: DataFrame | None = None, statistics=None) -> DataFrame:
        """key, score (BM25) of all documents that hold a term in one of ``fields`` (all
        fields otherwise), of ``ranges`` (segment, range) only if given."""
        terms = list(dict.fromkeys(terms))
        n, mean, df = statistics or self.statistics(terms)
        blocks = self._segments("blocks", terms)
        if ranges is not None:
            blocks = blocks.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi")
        rows = self._live(blocks.select("term", "segment", F.explode("docs").alias("d")).select("term", "segment", "d.key", "d.len", "d.tfs"))
        wanted = [i for i, f in enumerate(self.fields) if fields is None or f in fields]
        tf = reduce(lambda x, y: x + y, [F.get("tfs", F.lit(i)) for i in wanted], F.lit(0))
        part = F.when(tf > 0, _idf(terms, n, df) * _norm(tf, F.col("len"), mean, k1, b))
        return rows.withColumn("part", part).where("part IS NOT NULL").groupBy("key").agg(F.sum("part").alias("score"))

    def top(self, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75, slack: float = 1e-6) -> DataFrame:
        """key, score of documents among which the best ``k`` are, with all that come
        within ``slack`` of the last of them; rank them by the order that is wanted."""
        terms = list(dict.fromkeys(terms))
        own = self.statistics(terms)
        n, mean, df = own
        head = self._segments("blocks", terms).select("term", "segment", "range", "max_tf", "min_len")
        bound = F.sum(_idf(terms, n, df) * _norm(F.col("max_tf"), F.col("min_len"), mean, k1, b))
        bounds = head.groupBy("segment", "range").agg(bound.alias("bound"))
        probed = bounds.orderBy(F.desc("bound"), "segment", "range").limit(PROBED)
        best = self.scores(terms, k1, b, ranges=probed, statistics=own).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
        least = best[1] - slack if best[0] == k else -1.0
        open_ = bounds.where(F.col("bound") * (1 + 1e-9) >= least)
        return self.scores(terms, k1, b, ranges=open_, statistics=own).where(F.col("score") >= least)

    def compared(self, docs: DataFrame) -> DataFrame:
        """The index against its source, by keys: documents and words that it counts,
        documents that it lacks, and those that the source no longer has."""
        source = docs.select(F.col(self.key).alias("key"), F.lit(True).alias("s"))
        both = source.join(self.forward().select("key", "len"), "key", "full_outer")
        lists = both.agg(F.count("len").alias("listed"), F.count_if(F.col("len").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))
        of = lambda c: F.lit(sum(s[c] for s in self.segments)).cast("long").alias(c)
        return lists.select(of("docs"), of("words"), "listed", "missing", "extra")


def _idf(terms: list[str], n: int, df: dict[str, int]) -> Column:
    of = lambda t: math.log(1.0 + (n - df[t] + 0.5) / (df[t] + 0.5))
    return reduce(lambda c, t: c.when(F.col("term") == t, of(t)), terms[1:], F.when(F.col("term") == terms[0], of(terms[0])))


def _norm(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean or 1.0)))


_BUILT: dict[tuple, Index] = {}


def kept(source: DataFrame, docs: DataFrame, key: str, fields: list[str], name: str) -> Index:
    """The index over ``docs``, rows of the table ``source``: built when first asked for, and
    again when the table's files have changed. It lies in the shared folder, and this
    process knows it as long as the application runs."""
    spark = source.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.bit_xor(F.xxhash64("*"))).first()
    known = (spark.sparkContext.applicationId, name, key, *fields, *state)
    if known not in _BUILT:
        _BUILT[known] = Index(spark, new_folder(spark, f"index-{name}"), key, fields).build(docs)
    return _BUILT[known]
