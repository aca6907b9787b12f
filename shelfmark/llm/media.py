"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded with zeros to rows of 64, become an 8-bit grayscale PNG. Each
distinct payload is stored once, as a member of a tar shard named by its SHA-256; rows
carry digest, shard, offset and length. Texts that pad to one payload share it. Metadata
columns need only the first bytes of a member; features need all of them.
"""
from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, small_batches

WIDTH = 64
LEVEL = 6
SHARD_BYTES = 64 << 20
#: Bits of the broadcast map of digests that several rows have (8 MB), at any size of input.
BITS = 1 << 26
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER_BYTES = 33
INDEX = "digest binary, shard string, start long, length long"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes) -> bytes:
    """8-bit grayscale, 64 pixels wide, no filter."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not the header of a PNG file")
    width, height, bits = struct.unpack(">IIB", first[16:25])
    return width, height, bits


def decode_png(raw: bytes) -> bytes:
    width, height, _ = png_header(raw[:_HEADER_BYTES])
    at, body = 8, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Shards:
    """Tar shards of one task. Names are new for each attempt, so a task that runs again
    leaves at worst a shard that no index row names."""

    def __init__(self, folder: str):
        self._fs, self._path = _file_system(folder)
        self._fs.create_dir(self._path, recursive=True)
        self._out = None

    def add(self, digest: str, body: bytes) -> tuple[str, int, int]:
        if self._out is None:
            self._name, self._at = f"{uuid.uuid4().hex}.tar", 0
            self._out = self._fs.open_output_stream(f"{self._path}/{self._name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self._out.write(head)
        self._out.write(body)
        self._out.write(bytes(-len(body) % 512))
        start = self._at + len(head)
        self._at = start + len(body) + -len(body) % 512
        where = self._name, start, len(body)
        if self._at > SHARD_BYTES:
            self.close()
        return where

    def close(self) -> None:
        if self._out is not None:
            self._out.write(bytes(1024))
            self._out.close()
            self._out = None


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, n_bytes and the digest of the payload."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.octet_length(body).alias("n_bytes"))
    pad = F.when(F.col("n_bytes") == 0, WIDTH).otherwise(F.pmod(-F.col("n_bytes"), F.lit(WIDTH)))
    padded = F.concat(F.col("text"), F.repeat(F.lit("\0"), pad))
    return rows.select("doc_id", "text", F.col("n_bytes").cast("long").alias("n_bytes"), F.unhex(F.sha2(padded, 256)).alias("digest"))


def _bits(digest: str):
    """The word and the bit that stand for a digest."""
    place = F.pmod(F.xxhash64(digest), F.lit(BITS))
    return F.floor(place / 64), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({digest}), {BITS}L), 64L) as int))")


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the shards; returns rows (doc_id, n_bytes, digest, shard, start, length), one
    per row of ``docs``, and the index (columns as in INDEX), one row per payload.

    A bitmap of the digests that several rows have, of the same size for any input, is
    broadcast; payloads not in it are stored by the task that reads them. The others (and
    the few that share a bit with one) move once a task to the task that owns their
    digest. Null texts count as empty; rows may repeat; no rows give no rows; other columns
    of ``docs`` are not read."""
    keyed = _keyed(docs, doc_id, text)
    rows = checkpoint(keyed.select("doc_id", "n_bytes", "digest"))
    word, bit = _bits("digest")
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = several.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = keyed.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    marked = marked.select("digest", "text", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("moves"))

    def placed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "shard", "start", "length", "text"]
        )

    def write(batches):
        """Stores each payload that stays; of those that move, passes one on of what was met lately."""
        shards, lately = _Shards(folder), set()
        for batch in small_batches(batches, "text"):
            out: list[tuple] = []
            for digest, text, moves in zip(*[batch.column(c).to_pylist() for c in ("digest", "text", "moves")]):
                if not moves:
                    out.append((digest, *shards.add(digest.hex(), encode_png(payload(text))), None))
                elif digest not in lately:
                    lately.add(digest)
                    out.append((digest, None, None, None, text))
            if len(lately) > 1 << 16:
                lately.clear()
            yield placed(out)
        shards.close()

    def write_once(batches):
        """Rows in order of their digest: the first of each is stored."""
        shards, last = _Shards(folder), None
        for batch in small_batches(batches, "text"):
            out: list[tuple] = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                if digest != last:
                    last = digest
                    out.append((digest, *shards.add(digest.hex(), encode_png(payload(text))), None))
            yield placed(out)
        shards.close()

    schema = f"{INDEX}, text string"
    first = checkpoint(marked.mapInArrow(write, schema))
    moved = first.where("shard IS NULL").select("digest", "text").repartition("digest").sortWithinPartitions("digest")
    index = first.where("shard IS NOT NULL").unionByName(checkpoint(moved.mapInArrow(write_once, schema))).drop("text")
    return rows.join(index, "digest"), index


def _reading(folder: str, names: list[str], schema, each):
    """Reads members shard by shard, in order of their place; each(read, row) gives a row."""

    def run(batches):
        system, path = _file_system(folder)
        name, handle = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = row["shard"], system.open_input_file(f"{path}/{row['shard']}")

                def read(start, n, handle=handle):
                    handle.seek(start)
                    return handle.read(n)

                out.append(each(read, row))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema)], names=names)
        if handle is not None:
            handle.close()

    return run


def _by_shard(index: DataFrame) -> DataFrame:
    return index.repartition("shard").sortWithinPartitions("shard", "start")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits: from the first 33 bytes of each member."""

    def each(read, row):
        return row["digest"], *png_header(read(row["start"], _HEADER_BYTES))

    names, kinds = ["digest", "width", "height", "bits"], [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    return _by_shard(index).mapInArrow(_reading(folder, names, kinds, each), "digest binary, width long, height long, bits int")


def features(index: DataFrame, folder: str) -> DataFrame:
    """digest and what the stored bytes say: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (size from the header; sum, largest and number of
    distinct samples). A payload that does not match its digest raises."""

    def each(read, row):
        raw = read(row["start"], row["length"])
        data = decode_png(raw)
        digest = hashlib.sha256(data)
        if digest.digest() != row["digest"]:
            raise ValueError(f"payload {row['digest'].hex()} is damaged")
        samples = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        total, top = int(samples @ np.arange(256)), int(np.flatnonzero(samples)[-1])
        width, height, bits = png_header(raw[:_HEADER_BYTES])
        feature = f"{width}x{height}x{bits}:{total}:{top}:{int((samples > 0).sum())}"
        return row["digest"], len(data), digest.hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _by_shard(index).mapInArrow(
        _reading(folder, names, kinds, each),
        "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op5_media(spark, sf_dir):
    folder = shared_folder(spark, "media")
    rows, index = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    sizes = metadata(index, folder).select("digest", "width", "height")
    return rows.join(features(index, folder).join(sizes, "digest"), "digest").drop("digest")
