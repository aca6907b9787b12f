"""Quality rules: a threshold table compiled into one Spark projection.

Measures of a text (length, symbols, stop words, lines, repeats) are Spark columns; a
rule names a measure and the range in which it must lie. All rules become one
projection without user functions, so that a document is read once and nothing moves.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a al and as at au aux be by con da das de del dem den der des die du ein eine el elle en er es est et for from "
    "il im in is ist it la las le les lo los mit nicht no of on or os par para pas por pour qu que qui se sein sich "
    "sie son su sur that the this to un una und une von was with y zu"
).split()
SYMBOLS = "#*$%&|<>"
EDGES = ".,;:!?\"'()"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; a null bound does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        m = F.col(self.measure)
        tests = [m < self.low] if self.low is not None else []
        tests += [m > self.high] if self.high is not None else []
        return reduce(lambda a, b: a | b, tests)


#: The base rules come first; ratios are per word, or per line that has a word.
BASE_RULES = (Rule("too_short", "n_words", low=50), Rule("repeats", "repeat_ratio", high=50.0))
RULES = (
    Rule("odd_word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("few_stop_words", "stop_ratio", low=0.08),
    Rule("shouting", "upper_ratio", high=0.3),
    Rule("repeated_lines", "dup_line_ratio", high=0.4),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words, n_upper_words (long).

    A null text counts as empty; all measures of it are 0. n_repeat_words takes the
    3-word windows by 64-bit digest, sorted with their places: equal neighbours are
    windows found twice or more, and the words under them follow from the gaps between
    their places, so that the cost is n log n even for very long texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_text", t).withColumn("_q_words", _words(F.col("_q_text")))
    n = F.size("_q_words")
    window = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(
            F.xxhash64(
                F.element_at("_q_words", i), F.element_at("_q_words", i + 1), F.element_at("_q_words", i + 2)
            ).alias("h"),
            i.alias("i"),
        ),
    )
    df = df.withColumn("_q_windows", F.when(n >= 3, F.sort_array(window)))
    k = F.size("_q_windows")
    df = df.withColumn(
        "_q_same",
        F.when(
            k >= 2,
            F.zip_with(
                F.slice("_q_windows", F.lit(1), k - 1),
                F.slice("_q_windows", F.lit(2), k - 1),
                lambda a, b: a["h"] == b["h"],
            ),
        ),
    )
    df = df.withColumn(
        "_q_places",
        F.when(
            F.array_contains("_q_same", True),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_q_windows",
                        lambda x, i: F.coalesce(F.get("_q_same", i - 1), F.lit(False))
                        | F.coalesce(F.get("_q_same", i), F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    places = F.col("_q_places")
    covered = F.aggregate(
        F.zip_with(
            places,
            F.slice(places, F.lit(2), F.size(places)),
            lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
        ),
        F.lit(0),
        lambda x, y: x + y,
    )
    lines = F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("_q_lines", lines)
    plain = lambda w: F.btrim(w, F.lit(EDGES))
    length = lambda c: F.length(c).cast("long")
    taken = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words"}
    return df.select(
        *[c for c in docs.columns if c.lower() not in taken],
        n.cast("long").alias("n_words"),
        length(F.translate("_q_text", BLANKS, "")).alias("word_chars"),
        (length("_q_text") - length(F.translate("_q_text", SYMBOLS, ""))).alias("n_symbols"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_q_words", lambda w: F.lower(plain(w)).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_q_words", lambda w: (w != F.lower(w)) & (w == F.upper(w)) & (F.length(w) > 1)))
        .cast("long")
        .alias("n_upper_words"),
    )


def judge(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """``docs`` with its measures, base_failed, kept, and failed (names of the rules
    that it breaks, in table order). Empty and null texts fail too_short; repeated rows are
    judged alike; no rows give no rows. Columns of ``docs`` that bear the name of a
    measure or verdict are replaced by it; all others stay."""
    per = lambda c, of: F.coalesce(F.try_divide(F.col(c), F.col(of)), F.lit(0.0))
    m = measures(docs, text).withColumns(
        {
            "repeat_ratio": per("n_repeat_words", "n_words") * 100,
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "upper_ratio": per("n_upper_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
        }
    )
    failed = lambda table: reduce(lambda a, b: a | b, [r.failed() for r in table])
    # The base is decided on whole numbers.
    base_failed = failed(base[:1]) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50) if base == BASE_RULES else failed(base)
    return m.withColumns(
        {
            "base_failed": base_failed,
            "kept": ~(base_failed | failed(rules)),
            "failed": F.filter(
                F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull()
            ),
        }
    )


def keep(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns as they are: these
    travel in one struct, so that no measure can take the place of a column of that name.
    The row number in the condition keeps the optimizer from copying the measures into a
    filter below their projection, which would compute each many times over."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_doc"), F.col(text).alias("_q_own"))
    judged = judge(packed, "_q_own", base, rules).withColumn("_q_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_q_row") >= 0)).select("_q_doc.*")


def op2_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP2_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
c AS (
  SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains(string_split('@STOP@', ' '), lower(trim(w, '.,;:!?"''()')))))::BIGINT AS n_stop,
    len(list_filter(words, lambda w: w <> lower(w) AND w = upper(w) AND length(w) > 1))::BIGINT AS n_upper
  FROM d LEFT JOIN c USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.08
    AND n_upper / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.4 AS kept
FROM b""".replace("@STOP@", " ".join(STOP_WORDS))
