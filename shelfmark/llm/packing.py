"""Best-fit packing of documents into sequences, large items first.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the
plan is made on the histogram of lengths: items above one third of the capacity go two
at most into a sequence, matched greedily (the longest with the longest partner that
still fits); smaller ones then go, longest first, into the tightest gap that holds
them. The plan says for each length which of its items, by rank, go where; Spark ranks
the items by length in a range sort and looks their places up.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, running_total, small_batches
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, in order) with the number of sequences of each.

    The work depends on the number of distinct lengths, not on the number of items."""
    left = {n: k for n, k in histogram.items() if k}
    gaps: dict[int, list[list]] = {}
    open_gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append([pattern, times])

    def take(gap: int, most: int) -> tuple[tuple[int, ...], int]:
        held = gaps[gap][-1]
        times = min(most, held[1])
        held[1] -= times
        if not held[1]:
            gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
        return held[0], times

    large = sorted(n for n in left if n * 3 > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        partner = large[at] if at >= 0 else None
        if partner is None or (partner == n and left[n] == 1 and at == 0):
            put((n,), left.pop(n))
            large.pop()
            continue
        if partner == n and left[n] == 1:
            partner = large[at - 1]
        times = left[n] // 2 if partner == n else min(left[n], left[partner])
        put((n, partner), times)
        for m in (n, partner):
            left[m] -= times
        for m in {n, partner}:
            if not left[m]:
                del left[m]
                large.remove(m)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(open_gaps, n)
            if at < len(open_gaps):
                pattern, times = take(open_gaps[at], count)
                put(pattern + (n,), times)
                count -= times
            else:
                each = capacity // n
                if count >= each:
                    put((n,) * each, count // each)
                if count % each:
                    put((n,) * (count % each), 1)
                count = 0
    return [(p, k) for g in sorted(gaps) for p, k in gaps[g]]


def _slots(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in the order of their lengths: the index at which each slot begins, the
    sequence of its first item, and its offset there."""
    base, held = {}, 0
    for n in sorted(histogram):
        base[n] = held
        held += histogram[n]
    rows, sequence = [], 0
    for pattern, times in plan_bins(histogram, capacity):
        offset = 0
        for n in pattern:
            rows.append((base[n], sequence, offset))
            base[n] += times
            offset += n
        sequence += times
    rows.sort()
    first, sequences, offsets = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return first, sequences, offsets


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids). A document is
    its ids and ``end_id``; one longer than ``capacity`` is cut into full pieces, of which
    the first takes the remainder. Null and empty texts are the end id alone."""
    path = path or default_path()

    def cut(batches):
        for batch in small_batches(batches, "text", 2 << 20):
            ids, counts = encoder(path).encode(batch.column("text"))
            out: list[list] = [[], [], [], [], [], []]
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                start, size = 0, len(own)
                length = size % capacity or min(size, capacity)
                k = 0
                while start < size:
                    raw = own[start : start + length].tobytes()
                    for c, v in zip(out, (doc, k, start, length, zlib.crc32(raw), raw)):
                        c.append(v)
                    start, length, k = start + length, capacity, k + 1
            columns = [
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int32()),
                *[pa.array(c, pa.int64()) for c in out[2:5]],
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(out[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces with their sequence_id and offset. The driver sees the histogram of
    lengths (``capacity`` rows at most). Repeated rows are packed once each, pieces alike in
    length, id and number in any order among themselves; no rows give no rows; other columns
    of ``docs`` are not read, so their names may clash. With ``keep_ids`` the ids stay with each piece, for ``sequences``."""
    cut = checkpoint(pieces(docs, doc_id, text, path, capacity, end_id, keep_ids))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    first, sequences, offsets = _slots(histogram, capacity)
    order: list[Column] = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    ranked = running_total(cut.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_rank")
    names = cut.columns

    def place(batches):
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            slot = np.searchsorted(first, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequences[slot] + rank - first[slot]), pa.array(offsets[slot])],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, cut.schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pieces packed with ``keep_ids``: sequence_id, length, and
    ids as little-endian 32-bit integers. A sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))


def op10_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
