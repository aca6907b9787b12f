"""A content-addressed store of token ids.

Three Parquet tables in one folder of the shared store:

* ``packed/kind=chunk``: each distinct chunk once: its ids (``width`` bytes each, as few as
  hold them, little-endian), their number, and the SHA-256 of those bytes. A rolling hash over the last WINDOW ids decides
  where a chunk ends, so that equal passages give equal chunks wherever they stand.
* ``recipes``: one row per document in ascending doc_id order: start, n_tokens, the
  digests of its chunks in order, and the Merkle root over them.
* ``manifest``: a Merkle tree over the documents' roots. At level 0 a row for each segment
  of SEGMENT tokens, above it one for FANOUT nodes below, up to the one root of the store.
  Reading recomputes digests, roots and nodes, and stops at any mismatch.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, running_total, shared_folder, small_batches
from .tokens import default_path, encoder

END_ID = 2
WINDOW = 16
#: A chunk ends where the hash has this many zero bits: 512 ids on average.
ZERO_BITS = 9
LEAST, MOST = 64, 4096
SEGMENT = 1 << 20
FANOUT = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_POLY = 0xEDB88320


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last WINDOW ids asks for a cut, over the ids of
    many documents at once. A cut needs LEAST ids before it in its document, more than a
    window, so no window that a cut hangs on reaches into the document before."""
    n = len(ids)
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    sums = np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n])
    sums[WINDOW:] -= sums[:-WINDOW].copy()
    return np.flatnonzero(_mixed(sums * _POWERS[1][:n]) >> np.uint64(64 - ZERO_BITS) == 0) + 1


def cuts(asked: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids, LEAST to MOST long but for the last."""
    out, last = [], 0
    for end in [*asked, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs hashed level by level; an odd one moves up unchanged."""
    level = list(leaves)
    while len(level) > 1:
        level = [
            hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0] if level else hashlib.sha256(b"").digest()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reflected."""
    a, out = a.astype(np.uint64), np.zeros(len(a), np.uint64)
    b = b.astype(np.uint64)
    one = np.uint64(1)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, np.uint64(_POLY), np.uint64(0))
    return out


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer string, ``n_bytes`` before its end: the
    CRC of a whole is the exclusive or of its parts' CRCs, so shifted."""
    shift = np.full(len(crc), 1 << 31, np.uint64)
    step = np.full(1, 1 << 23, np.uint64)  # x^8: one byte
    rest = n_bytes.astype(np.uint64).copy()
    while rest.any():
        odd = (rest & np.uint64(1)).astype(bool)
        if odd.any():
            shift[odd] = _times(shift[odd], np.repeat(step, odd.sum()))
        step = _times(step, step)
        rest >>= np.uint64(1)
    return _times(shift, crc)


def _digest(body: bytes, width: int) -> bytes:
    """Of a chunk's bytes; one more byte tells wide ids from as many bytes of narrow ones."""
    return hashlib.sha256(body if width == 2 else body + b"\x04").digest()


def _chunks(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    def cut(batches):
        for batch in small_batches(batches, "text", 2 << 20):
            ids, counts = encoder(path).encode(batch.column("text"))
            wide = max(end_id, int(ids.max()) if len(ids) else 0) > 0xFFFF
            out: list[list] = [[] for _ in range(8)]
            seen: set[bytes] = set()
            ends = np.cumsum(counts) + np.arange(1, len(counts) + 1)
            whole = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            narrow = whole.astype("<u2").tobytes()
            asked = marks(whole) if len(whole) else whole
            slots = np.searchsorted(asked, np.append(0, ends), side="right")
            first = 0
            for k, (row, doc, last) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), ends.tolist())):
                begin, n = 0, last - first
                for end in cuts((asked[slots[k] : slots[k + 1]] - first).tolist(), n):
                    raw, width = narrow[(first + begin) * 2 : (first + end) * 2], 2
                    if wide and int(whole[first + begin : first + end].max()) > 0xFFFF:
                        raw, width = whole[first + begin : first + end].tobytes(), 4
                    digest = _digest(raw, width)
                    body = None
                    if digest not in seen:
                        seen.add(digest)
                        body = raw
                    for c, v in zip(out, (digest, body, row, doc, begin, end - begin, n, width)):
                        c.append(v)
                    begin = end
                first = last
            kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    names = ["digest", "body", "row", "doc_id", "begin", "n", "n_tokens", "width"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    return rows.mapInArrow(
        cut, "digest binary, body binary, row long, doc_id long, begin long, n long, n_tokens long, width int"
    )


def _once(batches):
    """Rows sorted by digest, bodies first: each body once, and a reference per row."""
    last = None
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        first = np.zeros(len(digests), bool)
        for i, d in enumerate(digests):
            first[i] = d != last
            last = d
        n, k = len(digests), int(first.sum())
        chunk, empty = batch.filter(pa.array(first)), pa.nulls(n, pa.binary())
        for kind, rows, body, size in (("chunk", chunk, chunk.column("body"), k), ("ref", batch, empty, n)):
            names = [c for c in batch.schema.names if c != "body"]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in names], body, pa.array([kind] * size)], names=[*names, "body", "kind"]
            )


def _nodes(below: DataFrame, level: int, place: str, size: int, n_docs) -> DataFrame:
    """Nodes over what stands below (``place`` in order, root in hex): a digest of digests."""
    parts = below.groupBy(F.floor(F.col(place) / size).alias("node")).agg(
        n_docs.alias("n_docs"), F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct(place, "root"))).alias("roots")
    )
    root = F.sha2(F.array_join(F.transform("roots", lambda r: r["root"]), ""), 256)
    return parts.select(F.lit(level).alias("level"), "node", "n_docs", "first", root.alias("root"))


def _manifest(recipes: DataFrame) -> DataFrame:
    """level, node, n_docs, first (token), root. A segment holds no more documents than
    tokens; the levels above are as many as the number of segments has digits."""
    leaves = recipes.select("start", F.col("start").alias("first"), F.hex("root").alias("root"))
    level = checkpoint(_nodes(leaves, 0, "start", SEGMENT, F.count("*")))
    every, last, k = level, level.agg(F.max("node")).first()[0] or 0, 0
    while last:
        last, k = last // FANOUT, k + 1
        level = _nodes(level, k, "node", FANOUT, F.sum("n_docs"))
        every = every.unionByName(level)
    return every


_RECIPE = "row long, doc_id long, start long, n_tokens long, chunks array<struct<begin:long,n:long,digest:binary>>, root binary"


def _with_root(batches):
    for batch in batches:
        roots = [merkle_root([c["digest"] for c in chunks]) for chunks in batch.column("chunks").to_pylist()]
        names = [c for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*names, "root"])


def write(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID
) -> None:
    """Encodes all documents and writes the store. Each text is encoded once and each
    chunk's ids move once, to the task that owns its digest. Null and empty texts are
    the end id alone; repeated rows share chunks and have a recipe each; no rows give
    empty tables. Other columns of ``docs`` are not read."""
    chunks = _chunks(docs, doc_id, text, path or default_path(), end_id)
    (
        chunks.repartition("digest")
        .sortWithinPartitions("digest", F.asc_nulls_last("body"))
        .mapInArrow(
            _once,
            "digest binary, row long, doc_id long, begin long, n long, n_tokens long, width int, body binary, kind string",
        )
        .write.partitionBy("kind")
        .option("parquet.enable.dictionary", "false")
        .parquet(f"{folder}/packed")
    )
    spark = docs.sparkSession
    refs = _packed(spark, folder).where("kind = 'ref'")
    recipes = checkpoint(
        refs.groupBy("row", "doc_id", "n_tokens").agg(
            F.sort_array(F.collect_list(F.struct("begin", "n", "digest"))).alias("chunks")
        )
    )
    ordered = running_total(recipes, [F.asc("doc_id"), F.asc("row")], "n_tokens", "start")
    ordered.select("row", "doc_id", "start", "n_tokens", "chunks").mapInArrow(_with_root, _RECIPE).write.parquet(
        f"{folder}/recipes"
    )
    _manifest(spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    schema = "digest binary, row long, doc_id long, begin long, n long, n_tokens long, width int, body binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/packed")


def _checked(batches):
    """Chunks as read from the files: their digest must be that of their bytes."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for digest, body, width in zip(*[batch.column(c).to_pylist() for c in ("digest", "body", "width")]):
            raw = body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()
            if _digest(body, width) != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its digest")
            for c, v in zip(out, (digest, len(raw) // 4, zlib.crc32(raw))):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
            names=["digest", "stored", "crc"],
        )


def _uses(batches):
    """Recipes as read from the files: a row per chunk, after the root is checked."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "n_tokens", "chunks", "root")]
        for row, doc, start, n_tokens, chunks, root in zip(*columns):
            if merkle_root([c["digest"] for c in chunks]) != root:
                raise ValueError(f"the recipe of document {doc} does not match its root")
            for c in chunks:
                for o, v in zip(out, (row, doc, start, n_tokens, c["begin"], c["n"], c["digest"])):
                    o.append(v)
        kinds = [*[pa.int64()] * 6, pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)],
            names=["row", "doc_id", "start", "n_tokens", "begin", "n", "digest"],
        )


def _placed(batches):
    for batch in batches:
        crc = batch.column("crc").to_numpy().astype(np.uint64)
        after = batch.column("after").to_numpy()
        names = [c for c in batch.schema.names if c not in ("crc", "after")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(crc_shifted(crc, after * 4).astype(np.int64))],
            names=[*names, "crc"],
        )


_USES = "row long, doc_id long, start long, n_tokens long, begin long, n long, digest binary"


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Raises if a node over the recipes does not match the manifest."""
    again = _manifest(spark.read.schema(_RECIPE).parquet(f"{folder}/recipes"))
    stored = spark.read.schema(again.schema).parquet(f"{folder}/manifest")
    if wrong := again.exceptAll(stored).union(stored.exceptAll(again)).take(1):
        raise ValueError(f"node {wrong[0]['node']} of level {wrong[0]['level']} does not match the manifest")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone. Each
    stored chunk is read and checked once; documents then put the CRCs of their chunks
    together, so that no ids move. A missing or short chunk raises."""
    verify_manifest(spark, folder)
    stored = _packed(spark, folder).where("kind = 'chunk'").select("digest", "body", "width")
    stored = stored.mapInArrow(_checked, "digest binary, stored long, crc long")
    uses = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes").mapInArrow(_uses, _USES)
    joined = uses.join(stored, "digest", "left").select(
        "row",
        "doc_id",
        "start",
        "n_tokens",
        F.when(F.col("stored") == F.col("n"), F.col("n"))
        .otherwise(F.raise_error(F.concat(F.lit("chunk missing or short: "), F.hex("digest"))).cast("long"))
        .alias("n"),
        F.col("crc"),
        (F.col("n_tokens") - F.col("begin") - F.col("n")).alias("after"),
    )
    placed = joined.mapInArrow(_placed, "row long, doc_id long, start long, n_tokens long, n long, crc long")
    return (
        placed.groupBy("row", "doc_id", "start", "n_tokens")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("_n"))
        .select(
            "doc_id",
            "start",
            F.when(F.col("_n") == F.col("n_tokens"), F.col("n_tokens"))
            .otherwise(F.raise_error(F.lit("a recipe lacks chunks")).cast("long"))
            .alias("n_tokens"),
            "ids_crc32",
        )
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of every document."""

    def wide(batches):
        for batch in batches:
            ids = [
                b if w == 4 else np.frombuffer(b, "<u2").astype("<u4").tobytes()
                for b, w in zip(batch.column("body").to_pylist(), batch.column("width").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.binary())], names=["digest", "ids"])

    stored = _packed(spark, folder).where("kind = 'chunk'").select("digest", "body", "width")
    uses = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes").mapInArrow(_uses, _USES)
    whole = (
        uses.join(stored.mapInArrow(wide, "digest binary, ids binary"), "digest")
        .groupBy("row", "doc_id", "start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "ids"))).alias("parts"))
    )
    return whole.select(
        "doc_id", "start", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def op4_token_store(spark, sf_dir):
    folder = shared_folder(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return checksums(spark, folder)
