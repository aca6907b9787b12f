"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens
them in order: texts are escaped, attachments become a placeholder each, whose reference
and number of tokens after expansion are recorded. A conversation is its turns, each
between marks; the loss mask is the places of assistant texts.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others; texts must not hold them bare.
_CONTROL = r"\||/?s>|/?INST\]"
_BARE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: A row of the output holds whole turns, up to about so many characters.
MOST_CHARS = 1 << 20

PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<turn:long,place:long,kind:string,uri:string,tokens:long>>"
OUTPUT = f"conv_id long, part int, text string, loss array<struct<start:long,end:long>>, attachments {ATTACHMENTS}, tokens_added long"


def escape(text: str) -> str:
    """One backslash more behind the first character of each control string."""
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Visitor:
    """Flattens parts into text; one method per kind of part."""

    def __init__(self, patch: int = 14, per_second: int = 25, per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page

    def flatten(self, parts: list[dict | None]) -> tuple[str, list[tuple[int, str, str, int]]]:
        """The text, and of each attachment its place in it, kind, reference and tokens.
        Null parts and parts of unknown kinds are errors only if they carry a reference;
        else their text is used."""
        out, found, length = [], [], 0
        for part in parts:
            if part is None:
                continue
            visit = getattr(self, f"visit_{part['kind']}", None)
            if visit is None:
                if part.get("uri"):
                    raise ValueError(f"a part of unknown kind: {part['kind']}")
                piece = self.visit_text(part)
            else:
                piece = visit(part)
            if isinstance(piece, tuple):
                piece, tokens = piece
                found.append((length, part["kind"], part.get("uri") or "", tokens))
            out.append(piece)
            length += len(piece)
        return "".join(out), found

    def visit_text(self, part) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part) -> tuple[str, int]:
        across = -(-max(part.get("width") or 0, 1) // self.patch)
        return "<|image|>", across * -(-max(part.get("height") or 0, 1) // self.patch)

    def visit_audio(self, part) -> tuple[str, int]:
        return "<|audio|>", max(1, round((part.get("seconds") or 0) * self.per_second))

    def visit_document(self, part) -> tuple[str, int]:
        return "<|document|>", max(part.get("pages") or 0, 1) * self.per_page


def text_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``parts``: one text part; a null text is empty."""
    null = lambda kind: F.lit(None).cast(kind)
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        null("string").alias("uri"),
        null("int").alias("width"),
        null("int").alias("height"),
        null("double").alias("seconds"),
        null("int").alias("pages"),
    )
    return df.withColumn("parts", F.array(part))


def render(turns: DataFrame, folder: str, visitor: Visitor | None = None) -> DataFrame:
    """Writes the formatted conversations and reads them back (columns as in OUTPUT).

    ``turns``: conv_id, turn, role, parts. Turns of a conversation are in order of turn,
    then role and parts, so that ties have one order; null roles are empty, null parts
    too, a null conv_id is a conversation of its own. A conversation streams through its
    task turn by turn; one longer than MOST_CHARS is spread over several rows, of whole
    turns each. Repeated turns are kept. No turns give no rows; other columns of ``turns``
    are not read, so their names may clash."""
    visitor = visitor or Visitor()

    def write(batches):
        state: dict = {"conv": None, "part": 0, "new": True}
        out: list[tuple] = []
        texts, loss, found, length = [], [], [], 0

        def flush():
            nonlocal texts, loss, found, length
            if texts:
                out.append((state["conv"], state["part"], "".join(texts), loss, found, sum(a["tokens"] for a in found)))
                state["part"] += 1
            texts, loss, found, length = [], [], [], 0

        for batch in batches:
            for conv, turn, role, parts in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "parts")]):
                if state["new"] or conv != state["conv"]:
                    flush()
                    state.update(conv=conv, part=0, new=False)
                elif length > MOST_CHARS:
                    flush()
                content, attached = visitor.flatten(parts or [])
                head = f"{TURN}{escape(role or '')}{TEXT}"
                at = length + len(head)
                if role == "assistant":
                    loss.append({"start": at, "end": at + len(content)})
                found += [dict(turn=turn, place=at + p, kind=k, uri=u, tokens=n) for p, k, u, n in attached]
                texts += [head, content, END]
                length = at + len(content) + len(END)
            if len(out) > 500:
                yield rows(out)
                out = []
        flush()
        yield rows(out)

    def rows(out):
        columns = list(zip(*out)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(OUTPUT))
    ordered = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("parts").cast(PARTS).alias("parts"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "parts")
    )
    ordered.mapInArrow(write, OUTPUT).write.parquet(folder)
    return turns.sparkSession.read.schema(OUTPUT).parquet(folder)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per formatted conversation, parsed back from its text: n_turns,
    turns_sha256 (role, line feed, text, line feed), loss_chars and loss_sha256 of what is
    under the loss mask, unescaped, formatted_chars, n_attachments, tokens_added. Texts
    are read in the pieces that they were written in, whatever their length; a null text
    was written as an empty one, and a conversation that nobody has written has no row."""

    def parse(batches):
        out: list[tuple] = []
        conv, new = None, True
        turns = loss = None
        sums = [0] * 5

        def close():
            if not new:
                out.append((conv, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), *sums[2:]))

        for batch in batches:
            names = ("conv_id", "text", "loss", "attachments", "tokens_added")
            for c, text, spans, found, added in zip(*[batch.column(n).to_pylist() for n in names]):
                if new or c != conv:
                    close()
                    conv, new, turns, loss, sums = c, False, hashlib.sha256(), hashlib.sha256(), [0] * 5
                end = 0
                for m in _PARSE.finditer(text):
                    if m.start() != end:
                        raise ValueError(f"conversation {c} cannot be parsed at {end}")
                    end = m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    sums[0] += 1
                if end != len(text):
                    raise ValueError(f"conversation {c} cannot be parsed at {end}")
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    sums[1] += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                sums[2] += len(text)
                sums[3] += len(found)
                sums[4] += added
            if len(out) > 5000:
                yield rows(out)
                out = []
        close()
        yield rows(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "tokens_added"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def rows(out):
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(
            parse,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
            "n_attachments long, tokens_added long",
        )
    )


def op7_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') v(t, r)")
    formatted = render(text_parts(turns.unionByName(own), "text"), shared_folder(spark, "chat"))
    return digests(formatted).drop("tokens_added")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + 23 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments
FROM e GROUP BY conv_id"""
