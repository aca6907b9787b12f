"""Personal data: fixed patterns as seeds, and identifiers found by bootstrapping.

Seeds are what the four fixed patterns find, and secrets: long words of letters and many
digits. Small numbers are seeds too, of what is no identifier. The words around them make
lexical patterns, exact ones and general ones: a word with the kind of characters that
follow it, a label that an equals sign or colon ends, the make of the word itself, and the
letters that it begins with. A bipartite graph links patterns with the identifiers that
stand in them, and Spark scores it in rounds, as Snowball does (Agichtein and Gravano,
2000): a pattern is as sure as the share of one kind among its known identifiers (unknown
ones speak neither for it nor against it), an identifier as sure as its patterns make it.
What a round finds makes further patterns in the next. Identifiers that end above a
threshold are spans too, of the kind of the seeds that led to them.

Everything is DataFrame expressions and joins; no Python runs on executors.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, written

_LOCAL = "A-Za-z0-9._%+-"
#: Each begins only where a run of its first class begins, or at the end of the match
#: before; repeats are possessive where nothing they could give back would match. Both
#: leave the leftmost matches as they are, and long runs cost linear time.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must have for a pattern to be tried.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_START, _BLANK = r"(?<![^\x20\x09-\x0D])", r"\x20\x09-\x0D"
#: What may be an identifier of some kind: words of digits in a row, a word with a digit
#: or an at sign, and an address in words (name at host dot org).
RUN = rf"{_START}[^{_BLANK}0-9]*+[0-9][^{_BLANK}]*+(?:(?<=[0-9)])\x20[^{_BLANK}\p{{L}}0-9]*+[0-9][^{_BLANK}\p{{L}}]*+(?![^{_BLANK}]))++"
WORD = rf"{_START}[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
_AT, _DOT = (rf"\x20[(\[]?{w}[)\]]?\x20" for w in ("at", "dot"))
SPOKEN = rf"(?i){_START}[{_LOCAL}]++{_AT}[A-Z0-9.-]++(?:{_DOT}[A-Z0-9-]++)++"
#: Seeds beside the fixed patterns: long words of letters and many digits, as keys and tokens are.
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+"
SUPPORT = 3
THRESHOLD = 0.8
ROUNDS = 3
#: Code points before and after a span in which its neighbours are looked for.
REACH = 128
_SPAN = "array<struct<start:int,end:int,value:string>>"
_MATCHES, _BLOCK = 128, 4096


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though lambdas within use it many times."""
    return F.transform(F.array(value), body)[0]


def _spans(matches: Column, pieces: Column) -> Column:
    """Places (code points, end exclusive) of the matches that split a text into pieces.
    Lengths are summed by blocks of matches first, so that no fold grows a long list."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(matches) / _MATCHES).cast("int") - 1)
    cut = lambda array, j: F.slice(array, j * _MATCHES + 1, F.lit(_MATCHES))

    def block(own, before, at):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(own)),
            F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, i: F.struct(
                (acc["at"] + F.length(F.element_at(before, i)) + F.length(F.element_at(own, i))).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + F.length(F.element_at(before, i))).alias("start"),
                        (acc["at"] + F.length(F.element_at(before, i)) + F.length(F.element_at(own, i))).alias("end"),
                        F.element_at(own, i).alias("value"),
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def placed(each):
        sums = F.transform(blocks, lambda j: F.aggregate(cut(each, j), F.lit(0), lambda x, y: x + y))
        bases = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        whole = lambda b: F.flatten(
            F.transform(blocks, lambda j: _let(cut(matches, j), lambda own: _let(cut(pieces, j), lambda before: block(own, before, F.get(b, j)))))
        )
        return _let(bases, whole)

    each = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
    return F.when(F.size(matches) > 0, _let(each, placed)).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total, i):
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _kept(kind: str, spans: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _found(df: DataFrame, text: str, name: str, pattern: str, hint: Column) -> DataFrame:
    """Adds a column of spans; texts without the hint get an empty list at once."""
    tried = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_pii_m", tried)
    df = df.withColumn("_pii_p", F.when(F.size("_pii_m") > 0, F.split(text, pattern, -1)))
    return df.withColumn(name, _spans(F.col("_pii_m"), F.col("_pii_p"))).drop("_pii_m", "_pii_p")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_pii_<kind>`` for each kind: the valid matches of its fixed pattern. ``text``
    must not be null."""
    for kind, pattern in PATTERNS.items():
        name = f"_pii_{kind}"
        df = _found(df, text, name, pattern, _HINTS[kind](F.col(text)))
        df = df.withColumn(name, _kept(kind, name))
    return df


#: Stands for each character of a span that is known, where more is looked for.
_MASK = "\x01"


def _masked(df: DataFrame, spans: str) -> DataFrame:
    """Overwrites spans (in order, none within another) in the column _pii_mask."""

    def parts(blocks, own):
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(own, i - 1)["end"])
        each = F.transform(
            own, lambda s, i: F.concat(_between(blocks, before(i), s["start"]), F.repeat(F.lit(_MASK), s["end"] - s["start"]))
        )
        return F.concat(F.array_join(each, ""), _between(blocks, F.element_at(own, -1)["end"], F.length("_pii_mask")))

    masked = _let(_blocks(F.col("_pii_mask")), lambda blocks: _let(F.col(spans), lambda own: parts(blocks, own)))
    return df.withColumn("_pii_mask", F.when(F.size(spans) > 0, masked).otherwise(F.col("_pii_mask")))


def candidate_spans(df: DataFrame) -> DataFrame:
    """Adds ``_pii_more``: identifier-like words and runs of them, without the marks at
    their edges, that touch no seed. A word of a free run is no candidate itself. What is
    known is overwritten in ``_pii_mask`` first, so that nothing that touches it is left."""
    here = F.col("_pii_mask")
    free = lambda name: F.filter(name, lambda s: ~s["value"].contains(_MASK))
    df = _found(df, "_pii_mask", "_pii_run", RUN, here.rlike(r"[0-9)]\x20[^A-Za-z0-9]*+[0-9]")).withColumn("_pii_run", free("_pii_run"))
    df = _masked(df, "_pii_run")
    df = _found(df, "_pii_mask", "_pii_said", SPOKEN, here.rlike(f"(?i){_DOT}")).withColumn("_pii_said", free("_pii_said"))
    df = _masked(df, "_pii_said")
    df = _found(df, "_pii_mask", "_pii_word", WORD, here.rlike("[0-9@]")).withColumn("_pii_word", free("_pii_word"))
    # A label before an equals sign or colon is context.
    front = r"^[^A-Za-z0-9]*+(?:[A-Za-z_-]{2,32}+[=:][^A-Za-z0-9]*+(?=[A-Za-z0-9]))?+"
    core = lambda v: F.regexp_extract(v, front + "(.*[A-Za-z0-9])", 1)
    lead = lambda v: F.length(F.regexp_extract(v, front, 0))
    trimmed = F.transform(
        F.concat("_pii_run", "_pii_said", "_pii_word"),
        lambda s: F.struct(
            (s["start"] + lead(s["value"])).alias("start"),
            (s["start"] + lead(s["value"]) + F.length(core(s["value"]))).alias("end"),
            core(s["value"]).alias("value"),
        ),
    )
    df = df.withColumn("_pii_more", F.filter(trimmed, lambda s: s["value"] != ""))
    return df.drop("_pii_run", "_pii_said", "_pii_word")


def _blocks(text: Column) -> Column:
    """A text in blocks, so that a place far behind is reached without counting from the start."""
    cut = lambda t: F.transform(
        F.sequence(F.lit(0), F.floor(F.length(t) / _BLOCK).cast("int")), lambda j: F.substring(t, j * _BLOCK + 1, F.lit(_BLOCK))
    )
    return _let(text, cut)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
    cut = F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * _BLOCK + 1, end - start)
    return F.when(end > start, cut).otherwise("")


def _make(value: Column) -> Column:
    """Which kinds of characters a value has, and how long it is as a power of two."""
    has = lambda mark, pattern: F.when(value.rlike(pattern), mark).otherwise("")
    marks = [has("a", "[a-z]"), has("A", "[A-Z]"), has("0", "[0-9]"), has("@", "@"), has(".", r"\."), has("-", "[-() ]")]
    return F.concat(F.lit("~"), *marks, F.floor(F.log2(F.greatest(F.length(value), F.lit(1)))).cast("string"))


def _own_patterns(value: Column) -> Column:
    """Patterns of a word of 16 letters, digits and underscores or more: that it looks drawn
    at random, with four letters and four digits at least, and its first four letters."""
    count = lambda c: F.length(F.regexp_replace(value, f"[^{c}]", ""))
    drawn = F.when((count("0-9") >= 4) & (count("A-Za-z") >= 4), "~drawn")
    begins = F.when(value.rlike("^[A-Za-z]{4}"), F.concat(F.lit("^"), F.substring(value, 1, 4)))
    found = F.filter(F.array(drawn, begins), lambda p: p.isNotNull())
    return F.when(value.rlike("^[A-Za-z0-9_]{16,}+$"), found).otherwise(F.array().cast("array<string>"))


def _slots(blocks: Column, length: Column, start: Column, end: Column, make: Column) -> Column:
    """The lexical patterns of a place: the two words before; one before and one after; one
    before if a colon or an equals sign leads to the place; one before with the make of
    what stands there. In lower case without marks and digits; words of marks alone are
    skipped, and so are words that reach beyond REACH."""
    left, right = F.greatest(start - REACH, F.lit(0)), F.least(end + REACH, length)
    empty = F.array().cast("array<string>")
    clean = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\x20]", ""))
    split = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    words = lambda c: F.filter(c, lambda w: w.rlike(r"[\p{L}\p{N}]"))

    def patterns(before, after):
        around = lambda ahead, behind: F.transform(
            F.concat(
                F.slice(F.concat(F.array(F.lit(""), F.lit("")), words(ahead)), -2, 2),
                F.slice(F.concat(words(behind), F.array(F.lit(""))), 1, 1),
            ),
            clean,
        )
        leads = before.rlike(r"[=:][^\p{L}\p{N}]*+$")
        told = lambda w: F.array(
            F.when((w[1] != "") & (w[0] != ""), F.concat_ws(" ", F.lit("<"), w[0], w[1])),
            F.when((w[1] != "") & (w[2] != ""), F.concat_ws(" ", F.lit("<>"), w[1], w[2])),
            F.when((w[1] != "") & leads, F.concat_ws(" ", F.lit("="), w[1])),
            F.when(w[1] != "", F.concat_ws(" ", F.lit("<"), w[1], make)),
        )
        # A word that the edge of the window may have cut is left out.
        first = lambda ws: F.when(left > 0, F.slice(ws, F.lit(2), F.size(ws))).otherwise(ws)
        last = lambda ws: F.when(right < length, F.slice(ws, F.lit(1), F.size(ws) - 1)).otherwise(ws)
        return _let(split(before), lambda b: _let(split(after), lambda a: _let(around(first(b), last(a)), told)))

    texts = F.array(F.struct(_between(blocks, left, start).alias("before"), _between(blocks, end, right).alias("after")))
    found = F.flatten(F.transform(texts, lambda t: patterns(t["before"], t["after"])))
    return F.coalesce(F.filter(found, lambda p: p.isNotNull()), empty)


def _strong(value: Column) -> Column:
    """Whether a value speaks for itself in any place: six digits or more, or a name at a
    host. Others count in the slots of accepted patterns only."""
    return value.rlike(r"^(?:[^0-9]*+[0-9]){6}") | value.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]")


_SEEDS = (*KINDS, "secret")
_ALL = "array<struct<kind:string,start:int,end:int,value:string,slots:array<string>>>"


def all_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_pii_all``: kind (null for candidates), start, end, value and slots (lexical
    patterns) of every seed and candidate. ``text`` must not be null."""
    df = base_spans(df, text).withColumn("_pii_mask", F.col(text))
    for kind in KINDS:
        df = _masked(df, f"_pii_{kind}")
    df = _found(df, "_pii_mask", "_pii_secret", SECRET, F.col("_pii_mask").rlike(SECRET))
    secret = lambda v: (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 6) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 4)
    df = df.withColumn("_pii_secret", F.filter("_pii_secret", lambda s: secret(s["value"])))
    df = candidate_spans(_masked(df, "_pii_secret"))
    tag = lambda k, c: F.transform(
        c, lambda s: F.struct(F.lit(k).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    )
    df = df.withColumn("_pii_all", F.concat(*[tag(k, f"_pii_{k}") for k in _SEEDS], tag(None, "_pii_more")))
    df = df.withColumn("_pii_blocks", F.when(F.size("_pii_all") > 0, _blocks(F.col(text)))).withColumn("_pii_length", F.length(text))
    slots = lambda s: F.concat(_slots(F.col("_pii_blocks"), F.col("_pii_length"), s["start"], s["end"], _make(s["value"])), _own_patterns(s["value"]))
    found = F.transform("_pii_all", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")], slots(s).alias("slots")))
    df = df.withColumn("_pii_all", F.when(F.size("_pii_all") > 0, found).otherwise(F.array().cast(_ALL)))
    return df.drop("_pii_more", "_pii_blocks", "_pii_length", "_pii_mask", *[f"_pii_{k}" for k in _SEEDS])


#: The kind of what is no identifier: at most four digits and no letter, or what looks like
#: a card's number or an address of the internet and fails its check.
_NONE = "none"


def _ordinary(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    small = value.rlike(r"^[^\p{L}@]*+$") & (digits <= 4)
    card = F.when(value.rlike(r"^[0-9](?:[\x20-]?+[0-9])++$") & digits.between(16, 19), ~_valid("card", value)).otherwise(F.lit(False))
    ip = F.when(value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), ~_valid("ip", value)).otherwise(F.lit(False))
    return small | card | ip


def discover(
    df: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, threshold: float = THRESHOLD
) -> DataFrame:
    """value, kind, pattern: identifiers that the bootstrapping accepts, a row for each
    accepted pattern that they stand in. ``df`` has the spans. Copies of a text add
    nothing: a pattern counts distinct identifiers, and needs ``support`` known ones of a
    kind. A pattern's confidence is the sum of the scores of its identifiers of the kind
    over that of all its known ones and one; an identifier's score is one less the product
    of what its patterns leave open; seeds keep score 1."""
    spans = df.select(F.explode("_pii_all").alias("s"))
    kind = F.coalesce("s.kind", F.when(_ordinary(F.col("s.value")), _NONE))
    edges = checkpoint(spans.select(kind.alias("kind"), "s.value", F.explode("s.slots").alias("pattern")).distinct())
    seeds = edges.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    links = edges.select("pattern", "value").distinct()
    known, of_pattern = seeds, Window.partitionBy("pattern")  # a row for each kind
    for _ in range(rounds):
        patterns = (
            links.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= threshold).alias("sure"))
            .withColumn("confidence", F.col("sum") / (F.sum("sum").over(of_pattern) + 1))
            .where((F.col("sure") >= support) & (F.col("confidence") >= threshold) & (F.col("kind") != _NONE))
            .select("pattern", "kind", "confidence")
        )
        told = (
            links.join(patterns, "pattern")
            .join(seeds.select("value").distinct(), "value", "left_anti")
            .groupBy("value", "kind")
            .agg((F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        )
        known = checkpoint(seeds.unionByName(told))
    best = known.join(seeds.select("value").distinct(), "value", "left_anti").where(F.col("score") >= threshold)
    best = best.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    slots = links.join(patterns, "pattern").select("value", "kind", "pattern")
    return best.join(slots, ["value", "kind"])


def _told(held: DataFrame, accepted: DataFrame) -> DataFrame:
    """_pii_row and _pii_new: the candidates of each row that are accepted, with their kind:
    those that speak for themselves wherever they stand, others in an accepted pattern."""
    each = held.select("_pii_row", F.explode(F.filter("_pii_all", lambda s: s["kind"].isNull())).alias("s"))
    place = ["_pii_row", "s.start", "s.end", "s.value"]
    accepted = checkpoint(accepted)
    alone = each.where(_strong(F.col("s.value"))).select(*place).join(accepted.select("value", "kind").distinct(), "value")
    weak = each.where(~_strong(F.col("s.value"))).select(*place, F.explode("s.slots").alias("pattern")).join(accepted, ["value", "pattern"])
    found = alone.select("_pii_row", "start", "end", "kind").unionByName(weak.select("_pii_row", "start", "end", "kind").distinct())
    return found.groupBy("_pii_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_pii_new"))


def _of(kind: str, spans: str) -> Column:
    named = F.transform(
        F.filter(spans, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.coalesce(named, F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def _joined(columns: list[Column]) -> Column:
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(F.array_sort(c), named) for c in columns]), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (all: base, secrets, discovered), n_more (those beyond the base)
    and n_spans. Null texts count as empty; repeated rows have a result each; no rows give
    no rows; other columns of ``docs`` are not read, so their names may clash with any.
    Only spans and their lexical patterns move between tasks, never texts. Of an
    identifier with equally sure kinds the last by name counts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_pii_row"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_pii_text"),
    )
    held = checkpoint(all_spans(rows, "_pii_text").drop("_pii_text"))
    whole = held.join(_told(held, discover(held)), "_pii_row", "left")
    base = [_of(k, "_pii_all") for k in KINDS]
    every = [F.concat(_of(k, "_pii_all"), _of(k, "_pii_new")) for k in _SEEDS]
    size = lambda columns: sum(F.size(c) for c in columns).cast("long")
    return whole.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(KINDS, base)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        (size(every) - size(base)).alias("n_more"),
        size(every).alias("n_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets, and
    n_chars, if there, set to the new length. Overlapping spans become one mark, of the
    kind that begins first. Null texts stay null; repeated rows are treated alike; no rows
    give no rows. Columns whose names begin with _pii_ must not be there. Spans are found
    once and written with the rows to the shared folder; only texts with candidates are
    joined with what bootstrapping accepts."""
    names = docs.columns
    if own := [c for c in names if c.lower().startswith("_pii_")]:
        raise ValueError(f"columns in use here: {own}")
    rows = docs.withColumn("_pii_row", F.monotonically_increasing_id()).withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    held = written(all_spans(rows, "_pii_text").drop("_pii_text"), shared_folder(docs.sparkSession, "spans"))
    open_ = F.exists("_pii_all", lambda s: s["kind"].isNull())
    asked = held.where(open_)
    more = _told(asked.select("_pii_row", "_pii_all"), discover(held.select("_pii_all")))

    def done(df):
        spans = F.concat(*[_of(k, "_pii_all") for k in _SEEDS], F.coalesce("_pii_new", F.array().cast("array<struct<start:int,end:int,kind:string>>")))
        df = df.withColumn("_pii_marks", F.array_sort(spans)).withColumn("_pii_blocks", F.when(F.size("_pii_marks") > 0, _blocks(F.col(text))))
        # The farthest end before each span: that of the span before, unless it lies within an earlier one.
        ends = _let(F.transform("_pii_marks", lambda s: s["end"]), _running_greatest)

        def parts(marks, ends, blocks):
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            put = lambda s, i: F.concat(_between(blocks, before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            each = F.transform(marks, lambda s, i: F.when(s["start"] >= before(i), put(s, i)).otherwise(""))
            return F.concat(F.array_join(each, ""), _between(blocks, F.element_at(ends, -1), F.length(text)))

        marked = _let(F.col("_pii_marks"), lambda m: _let(ends, lambda e: _let(F.col("_pii_blocks"), lambda b: parts(m, e, b))))
        df = df.withColumn(text, F.when(F.size("_pii_marks") > 0, marked).otherwise(F.col(text)))
        return df.select(*[F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names])

    empty = F.lit(None).cast("array<struct<start:int,end:int,kind:string>>")
    return done(held.where(~open_).withColumn("_pii_new", empty)).unionByName(done(asked.join(more, "_pii_row", "left")))


def _running_greatest(values: Column) -> Column:
    """The greatest of each value and all before it, by blocks, so that no list grows long."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(values) / _MATCHES).cast("int") - 1)
    cut = lambda j: F.slice(values, j * _MATCHES + 1, F.lit(_MATCHES))
    tops = F.transform(blocks, lambda j: F.array_max(cut(j)))
    bases = F.aggregate(tops, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.greatest(F.element_at(acc, -1), x)))
    inside = lambda own, base: F.transform(own, lambda x, i: F.greatest(base, F.array_max(F.slice(own, F.lit(1), i + 1))))
    whole = lambda b: F.flatten(F.transform(blocks, lambda j: _let(cut(j), lambda own: inside(own, F.get(b, j)))))
    return F.when(F.size(values) > 0, _let(bases, whole)).otherwise(values)


def op3_pii(spark, sf_dir):
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
