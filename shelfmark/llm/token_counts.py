"""Token counts of whole texts, huge ones in overlapping chunks that are spliced.

Texts of up to FAN * UNIT code points are encoded as they are. A longer one becomes units
of UNIT code points, one row each, and chunks of FAN units that overlap the next chunk by
one unit. A chunk is encoded with offsets, and so is its overlap on its own, which is how
the next chunk begins. Both stop being different at the first place where a word of the
pre-tokenizer begins in both: it reads from left to right and never looks back, so what
follows such a place depends on nothing before it, and ids are made within words. Places
so near the end of the chunk that text beyond it could move them do not count. A chunk
then stands for its tokens up to the place, less those that the next one has before it,
and a document's count is the sum over its chunks, in whatever task each is encoded.

Where a chunk and its overlap never agree (a word longer than the overlap), the document
is dealt again into chunks and overlaps FAN times as wide, until they agree or one chunk
holds it all.
"""
from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, small_batches, written
from .tokens import default_path, encoder

#: Code points of a unit, and units of a chunk.
UNIT, FAN = 4096, 8
LIMIT = 512
#: Code points after a place that the pre-tokenizer may look at: a contraction's, at most.
_AHEAD = 4


def word_starts(encoding) -> dict[int, int]:
    """Where words begin (code points), with the number of tokens before each."""
    out, last = {}, object()
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            out.setdefault(start, i)
        last = word
    return out


def splice(tokenizer, text: str, core: int, ahead: int) -> int | None:
    """Tokens of a chunk, whose overlap begins at ``core``, up to the first stable common
    boundary, less those that the next chunk has before it; nothing without a boundary."""
    own = word_starts(tokenizer.encode(text, add_special_tokens=False))
    after = word_starts(tokenizer.encode(text[core:], add_special_tokens=False))
    for place, before in sorted(after.items()):
        if core + place > len(text) - ahead:
            break
        if core + place in own:
            return own[core + place] - before
    return None


def _first_pass(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """A row with its count for each short text, a row for each unit of a huge one."""

    def dealt(batches):
        for batch in small_batches(batches, "text"):
            own, texts = encoder(path), batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            points = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            huge = [n > UNIT * FAN and own._cut for n in points]
            counts = own.encode(pc.if_else(pa.array(huge, pa.bool_()), pa.scalar("", pa.string()), pc.cast(texts, pa.string())))[1].tolist()
            out: list[list] = [[] for _ in range(7)]
            for i, (row, doc) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist())):
                whole = texts[i].as_py() if huge[i] else ""
                k = -(-len(whole) // UNIT)
                for at in range(k) if huge[i] else [None]:
                    unit = None if at is None else whole[at * UNIT : (at + 1) * UNIT]
                    for c, v in zip(out, (row, doc, n_bytes[i], None if huge[i] else counts[i], at, k, unit)):
                        c.append(v)
            kinds = (*[pa.int64()] * 6, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["row", "doc_id", "n_bytes", "n_tokens", "k", "units", "unit"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(dealt, "row long, doc_id long, n_bytes long, n_tokens long, k long, units long, unit string")


def _chunks(units: DataFrame, span: int, over: int) -> DataFrame:
    """row, doc_id, n_bytes, core, text: chunks of ``span`` units and ``over`` of the next
    chunk's; the last one takes the rest of the document with it."""
    own = F.floor(F.col("k") / span)
    groups = F.filter(F.array(own, F.when(F.col("k") % span < over, own - 1)), lambda g: g.isNotNull() & (g >= 0) & ((g == 0) | (g * span + over < F.col("units"))))
    parts = units.withColumn("g", F.explode(groups)).groupBy("row", "doc_id", "n_bytes", "units", "g").agg(F.sort_array(F.collect_list(F.struct("k", "unit"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["unit"]), "")
    goes_on = F.col("g") * span + span + over < F.col("units")
    return parts.select("row", "doc_id", "n_bytes", F.when(goes_on, F.lit(span * UNIT)).cast("long").alias("core"), whole.alias("text"))


def _counted(chunks: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens (null where a chunk found no boundary)."""

    def count(batches):
        for batch in small_batches(batches, "text"):
            own = encoder(path)
            ahead = max([_AHEAD, *(len(t.decode()) for t in own._added)])
            n = [
                len(own._tokenizer.encode(text, add_special_tokens=False)) if core is None else splice(own._tokenizer, text, core, ahead)
                for text, core in zip(batch.column("text").to_pylist(), batch.column("core").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n_bytes")], pa.array(n, pa.int64())], names=["row", "doc_id", "n_bytes", "n"])

    each = chunks.mapInArrow(count, "row long, doc_id long, n_bytes long, n long")
    return each.groupBy("row", "doc_id", "n_bytes").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def count(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row: as many tokens as the
    tokenizers library gives for the whole text, special strings inside texts included, no
    special tokens added.

    Null and empty texts have none; repeated rows and rows without an id have a row each;
    no rows give none; other columns are not read. Files whose pre-tokenizer is not the
    byte-level one encode whole texts whatever their length. Texts move only if they are
    huge, a unit a row; only a text without a boundary in any overlap meets in one task."""
    path, spark = path or default_path(), docs.sparkSession
    first = written(_first_pass(docs, doc_id, text, path), shared_folder(spark, "token-counts"))
    done = first.where("k IS NULL").select("doc_id", "n_bytes", "n_tokens")
    units, span = first.where("k IS NOT NULL").drop("n_tokens"), FAN
    while True:
        found = checkpoint(_counted(_chunks(units, span, span // FAN), path))
        done = done.unionByName(found.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        open_ = found.where("n_tokens IS NULL").select("row")
        if open_.isEmpty():
            return done.withColumn("over_limit", F.col("n_tokens") > limit)
        units, span = units.join(open_, "row", "left_semi"), span * FAN


def op13_token_counts(spark, sf_dir):
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
