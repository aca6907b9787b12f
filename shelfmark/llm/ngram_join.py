"""Exact Jaccard join of word shingle sets over a token-group matrix.

1. Equal sets become one class. Shingles are 64-bit digests; a class is known by a
   128-bit digest of its set.
2. A document can only reach another if they share one of its p rarest tokens, where p
   is one more than it may lack. Tokens of a fixed share of the digest range are counted
   exactly; a class whose p rarest tokens occur nowhere else leaves here. (Tokens held by
   one in 200 documents count as the most frequent.)
3. The rest are put into groups of similar documents by minimum digests, ROUNDS times;
   each group is linked within itself, and links make labels. Documents of one label, and
   small labels that are alike, then make the groups of the matrix.
4. The matrix lists, for each rarest token, the groups that have it; two groups that share
   one, and are not of one label, are a pair. A union of tokens is stored for each group.
   The overlap of two unions bounds that of any two members; only groups of pairs that
   reach the bound are opened, and a member queries a group only if its own overlap with
   the union allows a link. One link between two labels is enough to join them.
5. Links between labels make components.

Every step is exact but for equal 64-bit digests of different shingles (some 1e-9 for
this corpus). No step lists the pairs within a group, and no row or token is dropped.
Tokens are counted, ranked and joined by Spark, in exchanges that can spill; Python makes
sets of texts and tests the sets of one group at a time.
"""
from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as token_caches
from .common import checkpoint, small_batches
from .components import components

GROUP_DOCS, GROUP_TOKENS = 64, 200_000
ROUNDS = 3
QUERIES_A_GROUP = 2000
HOT_SHARE, HOT_LEAST = 200, 32
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digest and first byte of each word."""
    b = np.frombuffer(raw, np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up, out=sums[1:])
    return _mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct digests of its k-word shingles, with A-Z
    in lower case; of all its words if there are fewer; empty without words."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    factors = [_U(pow(_BASE, 3 + 2 * j, 1 << 64)) for j in range(k)]
    at = 0
    while at < len(raws):
        end, held = at, 0
        while end < len(raws) and (end == at or held + len(raws[end]) < _SEGMENT):
            held += len(raws[end]) + 1
            end += 1
        if held > 2 * _SEGMENT:  # one long text, in segments that end at blanks
            raw, parts, place = raws[at], [], 0
            while place < len(raw):
                cut = _BLANK.search(raw, min(place + _SEGMENT, len(raw)))
                stop = cut.start() if cut else len(raw)
                parts.append(_words(raw[place:stop])[0])
                place = stop
            words, bounds = np.concatenate(parts), np.array([0, sum(map(len, parts))])
        else:
            words, first = _words(b" ".join(raws[at:end]))
            starts = np.cumsum([0] + [len(r) + 1 for r in raws[at:end]])
            bounds = np.searchsorted(first, starts)
        n = len(words)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled[: n - j] += words[j:] * factors[j]
        rolled = _mixed(rolled)
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z - a >= k:
                out.append(np.unique(rolled[a : z - k + 1]))
            elif z > a:
                short = words[a:z] * np.array(factors[: z - a])
                out.append(_mixed(short.sum(keepdims=True) + _U(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = end
    return out


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sig(set_id: bytes) -> int:
    """The first half of a class's digest, as a number."""
    return int.from_bytes(set_id[:8], "little", signed=True)


def _group_keys(s: np.ndarray) -> list[int]:
    """For each round two minimum digests in one number: likely equal for similar sets only."""
    keys = []
    for r in range(ROUNDS):
        one, two = (_mixed(s ^ _U(0x5851F42D4C957F2D * (2 * r + j + 1) % 2**64)).min() for j in (0, 1))
        keys.append(int(np.array([one, two]).view(np.int64) @ np.array([1, 0x5851F42D4C957F2D])))
    return keys


def _least(n, threshold: Fraction):
    """The fewest tokens of n that a linked set shares."""
    return -(-n * threshold.numerator // threshold.denominator)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, set_id, sig; and rows of locally frequent tokens (token, held), which
    have no set. Tokens are counted over distinct sets."""

    def sign(batches):
        token_caches.release()
        for batch in small_batches(batches, "text"):
            sets = _sets(batch.column("text").to_pylist(), k)
            ids = [_set_id(s) if len(s) else None for s in sets]
            distinct = list({i: s for i, s in zip(ids, sets) if i is not None}.values())
            hot, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if distinct:
                hot, held = np.unique(np.concatenate(distinct), return_counts=True)
                often = held >= max(8, len(distinct) // HOT_SHARE)
                hot, held = hot[often], held[often]
            h = len(hot)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(h, pa.int64())]),
                    pa.array([len(s) for s in sets] + [None] * h, pa.int64()),
                    pa.array(ids + [None] * h, pa.binary()),
                    pa.array([i and _sig(i) for i in ids] + [None] * h, pa.int64()),
                    pa.array(np.concatenate([np.zeros(len(sets), np.int64), hot.view(np.int64)])),
                    pa.array([None] * len(sets) + held.tolist(), pa.int64()),
                ],
                names=["doc_id", "n", "set_id", "sig", "token", "held"],
            )

    return docs.mapInArrow(sign, "doc_id long, n long, set_id binary, sig long, token long, held long")


_COUNTED, _OTHER, _HOT = 0, 1, 2


def _prefixes(rows_in: DataFrame, k: int, t: Fraction, hot: np.ndarray, share: float) -> DataFrame:
    """sig, token: those of a class's rarest tokens that other classes of ``rows_in`` (a
    column text, or hashes) have too. Classes without such tokens give no row.

    Tokens in the lowest ``share`` of the digest range are counted. The order is: counted
    ones by their counts, the others, frequent ones; by digest in each. A class gives all
    its counted tokens, and of the others as many as it needs to have p."""
    column = rows_in.columns[0]
    counted = _U(min(int(share * 2**64), 2**64 - 1))

    def is_hot(tokens):
        if not len(hot):
            return np.zeros(len(tokens), bool)
        return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens

    def post(batches):
        token_caches.release()
        seen: set[int] = set()
        for batch in small_batches(batches, column):
            held = batch.column(column).to_pylist()
            owners, tokens, infos = [], [], []
            for s in _sets(held, k) if column == "text" else [np.frombuffer(h, np.uint64) for h in held]:
                if not len(s) or (sig := _sig(_set_id(s))) in seen:
                    continue
                seen.add(sig)
                p = len(s) - int(_least(len(s), t)) + 1
                frequent = is_hot(s)
                split = np.searchsorted(s, counted, side="right")
                parts = [s[:split][~frequent[:split]]]
                for other in (s[split:][~frequent[split:]], s[frequent]):
                    parts.append(other[: max(0, p - sum(map(len, parts)))])
                # What is still lacking (below 0: to spare), and each token's kind.
                lacking = p - sum(map(len, parts))
                tokens += parts
                owners.append(np.full(p - lacking, sig, np.int64))
                infos += [np.full(len(x), lacking * 4 + kind, np.int64) for kind, x in enumerate(parts)]
            if len(seen) > 1 << 17:
                seen.clear()
            if not owners:
                continue
            # As signed numbers in the order of the digests.
            flat = (np.concatenate(tokens) ^ _U(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(owners)), pa.array(flat), pa.array(np.concatenate(infos))], names=["sig", "token", "info"]
            )

    kind = F.pmod("info", F.lit(4))
    # Frequent tokens are known to be shared, so they may be dealt out by their owners.
    posted = rows_in.mapInArrow(post, "sig long, token long, info long").withColumn(
        "place", F.when(kind == _HOT, F.xxhash64("sig")).otherwise(F.col("token"))
    )
    distinct = posted.repartition("place").groupBy("place", "token", "sig").agg(F.first("info").alias("info"))
    counts = distinct.withColumn("df", F.count("*").over(Window.partitionBy("place", "token")))
    shared = counts.where((kind == _HOT) | (F.col("df") > 1)).select(
        "sig", "token", kind.alias("kind"), F.when(kind == _COUNTED, F.col("df")).otherwise(0).alias("df"), F.floor(F.col("info") / 4).alias("lacking")
    )
    # Tokens that none else has come first in the order, so each takes a place of the p.
    own = Window.partitionBy("sig")
    ranked = shared.withColumn("held", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("kind", "df", "token")))
    return ranked.where("rank <= lacking + held").select("sig", "token")


def _fetched(docs: DataFrame, wanted: DataFrame, n_wanted: int, k: int) -> DataFrame:
    """set_id, sig, n, keys, hashes: the sets of the wanted classes, read from the document
    that stands for each, and a key for each round of grouping. A bitmap of the digests of the wanted ids (16 bits an id, 8 MB at
    most) is broadcast first, so that the texts of few others move to the exact join."""

    def load(batches):
        seen: set[bytes] = set()
        for batch in small_batches(batches, "text"):
            ids = batch.column("set_id").to_pylist()
            sets = _sets(batch.column("text").to_pylist(), k)
            # Rows that share an id with the one wanted but not its text are left out, and
            # so are repeats of it.
            keep = []
            for i, (d, s) in enumerate(zip(ids, sets)):
                if len(s) and d not in seen and _set_id(s) == d:
                    seen.add(d)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in keep], pa.binary()),
                    pa.array([_sig(ids[i]) for i in keep], pa.int64()),
                    pa.array([len(sets[i]) for i in keep], pa.int64()),
                    pa.array([_group_keys(sets[i]) for i in keep], pa.list_(pa.int64())),
                    pa.array([sets[i].tobytes() for i in keep], pa.binary()),
                ],
                names=["set_id", "sig", "n", "keys", "hashes"],
            )

    bits = max(1 << 10, min(1 << 26, n_wanted * 16))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {bits}L) % 64 as int))")
    bitmap = wanted.groupBy(F.floor(place("doc_id") / 64).alias("_word")).agg(F.bit_or(bit("doc_id")).alias("_bits"))
    likely = docs.withColumn("_word", F.floor(place("doc_id") / 64)).join(F.broadcast(bitmap), "_word")
    likely = likely.where(F.col("_bits").bitwiseAND(bit("doc_id")) != 0).select("doc_id", "text")
    joined = likely.join(
        wanted.select(F.col("doc_id").alias("_d"), "set_id"), F.col("doc_id").eqNullSafe(F.col("_d"))
    ).select("text", "set_id")
    return joined.mapInArrow(load, "set_id binary, sig long, n long, keys array<long>, hashes binary")


def _by_group(batches, names):
    """(group, rows) for rows sorted by group, across batches."""
    group, held = None, []
    for batch in batches:
        for g, *row in zip(*[batch.column(c).to_pylist() for c in ("group", *names)]):
            if g != group:
                if held:
                    yield group, held
                group, held = g, []
            held.append(row)
    if held:
        yield group, held


class _Table:
    """The sets of one group as rows over the union of their tokens."""

    def __init__(self, sets: list[np.ndarray], t: Fraction, union: np.ndarray | None = None):
        self.t, self.union = t, np.unique(np.concatenate(sets)) if union is None else union
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.has = np.zeros((len(sets), len(self.union)), bool)
        for row, s in zip(self.has, sets):
            row[np.searchsorted(self.union, s)] = True

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Whether each set is linked with ``s``; none is opened if the union does not allow it."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == s]
        if len(at) < _least(len(s), self.t):
            return np.zeros(len(self.sizes), bool)
        both = self.has[:, at].sum(axis=1)
        return both * self.t.denominator >= (self.sizes + len(s) - both) * self.t.numerator


def _binaries(rows: list[tuple], names: tuple[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=list(names))


def _linked_within(t: Fraction):
    """u, v: each set of a group with the smallest set_id of the part it hangs together with."""

    def link(batches):
        for _, rows in _by_group(batches, ("set_id", "hashes")):
            held = {i: np.frombuffer(h, np.uint64) for i, h in rows}
            if len(held) < 2:
                continue
            ids = sorted(held)
            sets = [held[i] for i in ids]
            table, label = _Table(sets, t), np.arange(len(ids))
            for i, s in enumerate(sets):
                found = np.unique(label[table.linked(s)])
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
            if out := [(ids[i], ids[j]) for i, j in enumerate(label.tolist()) if i != j]:
                yield _binaries(out, ("u", "v"))

    return link


def _unions(members: DataFrame) -> DataFrame:
    """group, low, tokens: the union of each group's sets and the size of its smallest.
    ``members``: group, hashes."""

    def unite(batches):
        for group, rows in _by_group(batches, ("hashes",)):
            sets = [np.frombuffer(h, np.uint64) for (h,) in rows]
            union = np.unique(np.concatenate(sets)).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int64()), pa.array([min(map(len, sets))], pa.int64()), pa.array([union], pa.binary())],
                names=["group", "low", "tokens"],
            )

    ordered = members.select("group", "hashes").repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(unite, "group long, low long, tokens binary")


def _dealt(asked: DataFrame, asks: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """Both with a column salt, for a join on (group, salt): a group that very many rows of
    ``asks`` ask for is repeated over several tasks."""
    salts = asks.groupBy("group").agg(F.ceil(F.count("*") / QUERIES_A_GROUP).cast("int").alias("salts"))
    repeated = asked.join(salts, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return repeated, asks.join(salts, "group").withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int")).drop("salts")


def _bounded(pairs: DataFrame, unions: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (query_group, group) whose unions overlap enough for a link of any two
    members. No member is read."""
    asked, asks = _dealt(
        unions.select("group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_group"), "low", "tokens"),
        pairs.select("group", F.lit(1).alias("kind"), "query_group"),
        F.col("query_group"),
    )
    asks = asks.join(unions.select(F.col("group").alias("query_group"), "low", "tokens"), "query_group")

    def bound(batches):
        union, low = None, 0
        for batch in batches:
            out = []
            for group, kind, query, least, raw in zip(*[batch.column(c).to_pylist() for c in ("group", "kind", "query_group", "low", "tokens")]):
                tokens = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    union, low = tokens, least
                    continue
                few, many = sorted((tokens, union), key=len)
                at = np.searchsorted(many, few)
                at[at == len(many)] = 0
                if query == group or (many[at] == few).sum() >= _least(max(low, least), t):
                    out.append((query, group))
            u, v = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["query_group", "group"])

    stream = asked.unionByName(asks).repartition("group", "salt").sortWithinPartitions("group", "salt", "kind")
    return stream.select("group", "kind", "query_group", "low", "tokens").mapInArrow(bound, "query_group long, group long")


def _opened(pairs: DataFrame, members: DataFrame, t: Fraction) -> DataFrame:
    """u, v: labels with a link between them. ``pairs``: query_group, group; ``members``:
    set_id, group, label, hashes. Members of the query groups ask the groups."""
    asked, asks = _dealt(
        members.join(pairs.select("group").distinct(), "group").select("group", F.lit(0).alias("kind"), "set_id", "label"),
        pairs.join(members.select(F.col("group").alias("query_group"), "set_id", "label"), "query_group").select(
            "group", F.lit(1).alias("kind"), "set_id", "label"
        ),
        F.col("set_id"),
    )
    needed = asked.unionByName(asks).join(members.select("set_id", "hashes"), "set_id")

    def ask(batches):
        at, held, table, found = None, [], None, set()
        for batch in batches:
            out: list[tuple] = []
            for group, salt, kind, label, raw in zip(*[batch.column(c).to_pylist() for c in ("group", "salt", "kind", "label", "hashes")]):
                if (group, salt) != at:
                    at, held, table, found = (group, salt), [], None, set()
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    held.append((label, s))
                    continue
                if table is None:
                    table = _Table([x for _, x in held], t)
                for i in np.flatnonzero(table.linked(s)).tolist():
                    if held[i][0] != label and (label, held[i][0]) not in found:
                        found.add((label, held[i][0]))
                        out.append((label, held[i][0]))
            if out:
                yield _binaries(out, ("u", "v"))

    stream = needed.repartition("group", "salt").sortWithinPartitions("group", "salt", "kind")
    return stream.select("group", "salt", "kind", "label", "hashes").mapInArrow(ask, "u binary, v binary").distinct()


def _groups(labelled: DataFrame) -> DataFrame:
    """Adds ``group``: parts of a large label, or small labels that have a key in common.
    ``labelled``: set_id, label, n, key."""
    chunks = lambda docs, tokens: F.greatest(F.ceil(docs / GROUP_DOCS), F.ceil(tokens / GROUP_TOKENS))
    labels = labelled.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.min("key").alias("home"))
    labels = labels.withColumn("large", (F.col("docs") * 2 > GROUP_DOCS) | (F.col("tokens") * 2 > GROUP_TOKENS))
    homes = labels.where("NOT large").groupBy("home").agg(chunks(F.sum("docs"), F.sum("tokens")).alias("chunks"))
    small = labels.where("NOT large").join(homes, "home").select(
        "label", F.xxhash64("home", F.pmod(F.xxhash64("label"), F.col("chunks"))).alias("group"), F.lit(None).cast("long").alias("parts")
    )
    large = labels.where("large").select(
        "label", F.lit(None).cast("long").alias("group"), chunks(F.col("docs"), F.col("tokens")).cast("long").alias("parts")
    )
    part = F.xxhash64("label", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    return labelled.join(small.unionByName(large), "label").select("set_id", "sig", "label", "n", F.coalesce("group", part).alias("group"))


def _pairs(matrix: DataFrame, t: Fraction) -> DataFrame:
    """query_group, group: pairs of groups with a rarest token in common that are not of
    one label and whose sizes allow a link; and a group with itself if it has several
    labels. The smaller group asks. ``matrix``: token, group, docs, low, high, first, last."""
    names = ("group", "docs", "low", "high", "first", "last")
    other = matrix.select("token", *[F.col(c).alias(f"{c}_2") for c in names])
    a, b = t.numerator, t.denominator
    several = (F.col("first") != F.col("last")) | (F.col("first_2") != F.col("last_2")) | (F.col("first") != F.col("first_2"))
    sizes = (F.col("low") * a <= F.col("high_2") * b) & (F.col("low_2") * a <= F.col("high") * b)
    both = matrix.join(other, "token").where((F.col("group") < F.col("group_2")) & several & sizes)
    smaller = F.col("docs") <= F.col("docs_2")
    found = both.select(
        F.when(smaller, F.col("group")).otherwise(F.col("group_2")).alias("query_group"),
        F.when(smaller, F.col("group_2")).otherwise(F.col("group")).alias("group"),
    ).distinct()
    alone = matrix.where(F.col("first") != F.col("last")).select(F.col("group").alias("query_group"), "group").distinct()
    return found.unionByName(alone)


def component_ids(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, threshold: Fraction = Fraction(9, 10)
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, set_id.

    Documents whose shingle sets have a Jaccard similarity of ``threshold`` or more are
    linked; component_id is the smallest doc_id reachable by links. Null texts and texts
    without words have an empty set, no set_id, and their own doc_id as component_id.
    Equal sets are linked; repeated rows too. Rows without an id take part, and null
    stands for a component only if none of its rows has an id. Other columns are not
    read. No rows give no rows."""
    t = Fraction(threshold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = checkpoint(_signatures(rows, k))
    own = signed.where("n IS NOT NULL").select("doc_id", "n", "set_id")
    classes = checkpoint(
        signed.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    )
    # Bounded: no more tokens than HOT_SHARE times the mean size of a set can be so frequent.
    least = max(HOT_LEAST, classes.count() // HOT_SHARE)
    hot_rows = signed.where("held IS NOT NULL").groupBy("token").agg(F.sum("held").alias("held")).where(F.col("held") >= least)
    hot = np.sort(np.array([r[0] for r in hot_rows.select("token").collect()], np.int64).view(np.uint64))

    # First over a share of the range with some tokens to spare, for all documents; then
    # over all tokens of the few that are left, whose sets are fetched for it.
    shared = _prefixes(rows.select("text"), k, t, hot, float(1 - t) * 1.6 + 0.04).select("sig").distinct()
    likely = checkpoint(classes.join(shared, "sig").select("set_id", "doc_id"))
    fetched = checkpoint(_fetched(rows, likely, likely.count(), k))
    prefixes = checkpoint(_prefixes(fetched.select("hashes"), k, t, hot, 1.0))
    # A repeated row may have brought its set twice.
    near = checkpoint(fetched.join(prefixes.select("sig").distinct(), "sig").dropDuplicates(["sig", "set_id"]))

    # Groups of similar sets, linked within themselves.
    keyed = near.select("set_id", "n", F.posexplode("keys").alias("round", "key"))
    sizes = keyed.groupBy("round", "key").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).where("docs > 1")
    sizes = sizes.select("round", "key", F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.ceil(F.col("tokens") / GROUP_TOKENS)).alias("chunks"))
    grouped = keyed.join(sizes, ["round", "key"]).select(
        "set_id", F.xxhash64("round", "key", F.pmod(F.xxhash64("set_id", "round"), F.col("chunks"))).alias("group")
    )
    within = grouped.join(near.select("set_id", "hashes"), "set_id").repartition("group").sortWithinPartitions("group")
    labels = components(within.select("group", "set_id", "hashes").mapInArrow(_linked_within(t), "u binary, v binary"))
    labelled = near.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").select(
        "set_id", "sig", F.coalesce("label", "set_id").alias("label"), "n", F.col("keys")[0].alias("key")
    )
    parted = checkpoint(_groups(labelled))

    # The matrix: which groups have a token among their rarest.
    docs_of = parted.groupBy("group").agg(F.count("*").alias("docs"))
    tokens = prefixes.join(parted.join(docs_of, "group"), "sig")
    matrix = checkpoint(
        tokens.groupBy("token", "group").agg(
            F.first("docs").alias("docs"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last")
        )
    )
    pairs = checkpoint(_pairs(matrix, t))
    asking = pairs.select(F.explode(F.array("query_group", "group")).alias("group")).distinct()
    members = checkpoint(parted.join(asking, "group").join(near.select("set_id", "hashes"), "set_id").select("set_id", "group", "label", "hashes"))
    unions = checkpoint(_unions(members))
    links = _opened(checkpoint(_bounded(pairs, unions, t)), members, t)
    merged = components(links).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    final = checkpoint(parted.join(merged, "label", "left").select("set_id", F.coalesce("merged", "label").alias("part")))
    least_id = final.join(classes.select("set_id", "doc_id"), "set_id").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_class = final.join(least_id, "part").select("set_id", "component_id")
    of_class = classes.join(of_class, "set_id", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return own.join(of_class, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "set_id",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that with the smallest
    id. Documents without words stay. Rows that share an id are kept once per distinct
    text, if their id is kept."""
    found = component_ids(docs, doc_id, text, k, threshold)
    kept = checkpoint(
        found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("rows")).where("stays")
    ).select(F.col("doc_id").alias("_kept_id"), F.col("rows").alias("_kept_rows"))
    joined = docs.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept_id")))
    once = joined.where("_kept_rows = 1").select(*docs.columns)
    return once.unionByName(joined.where("_kept_rows > 1").select(*docs.columns).dropDuplicates([doc_id, text]))


def op1_ngram_join(spark, sf_dir):
    return component_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_id")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, sh FROM (
    SELECT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ') || chr(10)] ELSE [] END) AS sh FROM d)),
n AS (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid),
e AS (
  SELECT a.rid AS u, b.rid AS v FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid
  GROUP BY a.rid, b.rid
  HAVING 100 * count(*) >= 90 * ((SELECT n FROM n WHERE n.rid = a.rid) + (SELECT n FROM n WHERE n.rid = b.rid) - count(*))),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (
  SELECT rid AS a, rid AS b FROM d
  UNION
  SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""
