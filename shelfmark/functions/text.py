"""Text functions as Spark columns."""
from __future__ import annotations

import functools
import json
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _unmarked(c: str, form: str) -> str:
    return "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")


@functools.cache
def _folds(form: str, ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """Characters that decompose into one (as two equally long texts), and those that
    decompose into several, by the given normal form. Marks that stand alone are left to
    the caller, and so are Hangul syllables, which have no marks to lose."""
    one, to, several = [], [], {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.decomposition(c):
            plain = _unmarked(c, form)
            if ascii_only:
                plain = plain.encode("ascii", "ignore").decode()
            if len(plain) == 1 and plain != c:
                one.append(c)
                to.append(plain)
            elif len(plain) > 1:
                several[c] = plain
    return "".join(one), "".join(to), several


def _ranges(characters: dict[str, str], gap: int = 64) -> str:
    """A pattern of few ranges that holds all characters, and some between them: the time
    that a pattern takes for each character of a text grows with its parts."""
    held: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if held and c - held[-1][1] <= gap:
            held[-1][1] = c
        else:
            held.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in held) + "]"


def _folded(text: Column, form: str, ascii_only: bool) -> Column:
    one, to, several = _folds(form, ascii_only)
    if several:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_ranges(several)), F.lit(0)))
        table = F.from_json(F.lit(json.dumps(several, ensure_ascii=False)), "map<string,string>")
        known = F.filter(found, lambda c: F.map_contains_key(table, c))
        text = F.aggregate(known, text, lambda acc, c: F.replace(acc, c, F.element_at(table, c)))
    return F.translate(text, one, to)


def fold(text: Column) -> Column:
    """Letters without their accents (canonical decomposition without marks, over all of
    Unicode); letters that do not decompose stay."""
    return F.regexp_replace(_folded(text, "NFD", False), r"\p{Mn}", "")


_SLUG_DROPPED = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in " \t\n\x0b\f\r-"))
_LOWER = bytes(range(256)).lower()


def _slugged(text: str | None) -> str:
    plain = (text or "").encode() if (text or "").isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore")
    kept = plain.translate(_LOWER, _SLUG_DROPPED).strip()
    joined = b"-".join(kept.replace(b"-", b" ").split())
    before, after = kept.startswith(b"-"), kept.endswith(b"-") and joined
    return (b"-" * bool(before) + joined + b"-" * bool(after)).decode()


def slug(text: Column) -> Column:
    """Compatibility decomposition, other non-ASCII dropped, lower case, letters, digits
    and single hyphens only; null and empty give empty."""

    @F.pandas_udf("string")
    def slugs(texts: pd.Series) -> pd.Series:
        return texts.map(_slugged)

    return slugs(F.coalesce(text, F.lit("")))


def owner_slug(text: Column) -> Column:
    """Lower case, spaces to underscores, other characters outside the list one to one."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("_")), r"[^a-z0-9&_'éèêëàâäöüçñ-]", "_")


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def file_slug(text: Column, most: int = 100) -> Column:
    """Letters, digits, hyphens and single underscores, cut to a length."""
    return F.left(F.btrim(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), "_+", "_"), F.lit("_")), F.lit(most))


def query_hash(text: Column) -> Column:
    return F.sha2(squeeze(F.lower(text)), 256)


def price(text: Column) -> Column:
    """The first number in a text, thousands separators dropped."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def grams(text: Column) -> Column:
    """A weight in grams, truncated; the first unit that matches counts, grams before
    kilograms, ounces and pounds."""
    low = F.lower(text)

    def unit(pattern: str, factor: float) -> Column:
        n = F.regexp_extract(low, rf"([0-9]+(?:\.[0-9]+)?)\s*{pattern}", 1).try_cast("double")
        return (n * factor).cast("int")

    return F.coalesce(unit(r"g(?:r|rams?)?\b", 1.0), unit("kg", 1000.0), unit("oz", 28.35), unit("lbs?", 453.59))


def title(text: Column) -> Column:
    """Upper case after every character that is not a letter."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


#: Words before and after the name of a farm, without the blank between.
FARM_PREFIXES = (
    "finca",
    "hacienda",
    "fazenda",
)
FARM_SUFFIXES = (
    "coffee processing center",
    "coffee farm",
    "washing station",
    "drying station",
    "community farmers",
    "coffee",
    "station",
    "farm",
    "village",
)


def bare_name(text: Column) -> Column:
    """Folded lower case without one known prefix and one known suffix."""
    low = F.btrim(F.lower(fold(text)), F.lit(" \t\n\x0b\f\r"))
    head = F.regexp_replace(low, f"^(?:{'|'.join(FARM_PREFIXES)}) ", "")
    return F.btrim(F.regexp_replace(head, rf" (?:{'|'.join(FARM_SUFFIXES)})\z", ""), F.lit(" \t\n\x0b\f\r"))


#: Words that are no surnames.
NOT_SURNAMES = (
    "and",
    "&",
    "family",
    "families",
    "brothers",
    "sisters",
    "smallholder",
    "smallholders",
    "farmers",
    "producers",
    "various",
    "regional",
    "lot",
    "collective",
    "community",
    "cooperative",
    "coop",
    "coffee",
    "farm",
    "finca",
    "proyecto",
    "project",
    "small",
    "farming",
)


def surnames(text: Column) -> Column:
    """Distinct words of three letters or more that may be surnames."""
    word = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
    found = F.regexp_extract_all(F.lower(fold(text)), F.lit(word), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in NOT_SURNAMES]))
