"""The boolean search language, compiled to Spark columns.

    or      := and ('|' and)*
    and     := not ('&' not)*
    not     := '!' primary | primary          (the word NOT means '!')
    primary := '(' or ')' | words or "quoted text"

Adjacent words are one phrase. ``*`` and ``?`` are wildcards; a term with wildcards is
anchored at both ends, one without matches anywhere. Quoted text must equal the field.
Matching ignores case. Missing operands raise ValueError.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    text: str
    exact: bool = False


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


_TOKEN = re.compile(r'"([^"]*)"?|([|&!()])|([^\s"|&!()]+)')


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind 'exact', 'word' or the operator itself."""
    out = []
    for quoted, operator, word in _TOKEN.findall(text):
        if operator:
            out.append((operator, operator))
        elif word:
            out.append(("!", "!") if word.upper() == "NOT" else ("word", word))
        else:
            out.append(("exact", quoted))
    return out


def parse(text: str):
    """The tree of a query. Text without operators or quotes is one term as it stands."""
    if not re.search(r'["|&!()]|(?:^|\s)not(?:\s|$)', text, re.I):
        if not text.strip():
            raise ValueError("an empty query")
        return Term(text.strip())
    stream, at = tokens(text), 0

    def peek() -> str | None:
        return stream[at][0] if at < len(stream) else None

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "|":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both():
        nonlocal at
        parts = [negated()]
        while peek() == "&":
            at += 1
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def negated():
        nonlocal at
        if peek() == "!":
            at += 1
            return Not(negated())
        return primary()

    def primary():
        nonlocal at
        if peek() == "(":
            at += 1
            inside = either()
            if peek() != ")":
                raise ValueError(f"a bracket is not closed: {text}")
            at += 1
            return inside
        if peek() == "exact":
            at += 1
            return Term(stream[at - 1][1], exact=True)
        words = []
        while peek() == "word":
            words.append(stream[at][1])
            at += 1
        if not words:
            raise ValueError(f"an operand is missing: {text}")
        return Term(" ".join(words))

    tree = either()
    if at < len(stream):
        raise ValueError(f"an operator is missing before {stream[at][1]!r}: {text}")
    return tree


def wildcard_regex(term: str) -> str:
    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in term]
    return f"(?is)^{''.join(parts)}$"


def scalar_term(column: Column) -> Callable[[Term], Column]:
    """How a term tests a text column."""

    def test(term: Term) -> Column:
        if term.exact:
            return F.lower(column) == term.text.lower()
        if "*" in term.text or "?" in term.text:
            return column.rlike(wildcard_regex(term.text))
        return F.lower(column).contains(term.text.lower())

    return test


def scalar_term_of(query: str) -> Callable[[Column], Column]:
    """The predicate of a query as a function of a column, for use inside arrays."""
    return lambda column: matches(query, scalar_term(column))


def array_term(column: Column) -> Callable[[Term], Column]:
    """How a term tests an array: quoted text must equal an element; other terms match
    the elements joined by spaces, so that a phrase may span two of them."""
    joined = scalar_term(F.array_join(column, " "))

    def test(term: Term) -> Column:
        if term.exact:
            return F.exists(column, lambda x: F.lower(x) == term.text.lower())
        return joined(term)

    return test


def compile_tree(tree, test: Callable[[Term], Column]) -> Column:
    if isinstance(tree, Term):
        return test(tree)
    if isinstance(tree, Not):
        return ~compile_tree(tree.of, test)
    parts = [compile_tree(p, test) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(tree, Both) else out | p
    return out


def matches(text: str, test: Callable[[Term], Column]) -> Column:
    """The predicate of a query. A null field gives null, negated or not."""
    return compile_tree(parse(text), test)


def scoring_terms(text: str) -> list[Term]:
    """The terms that add to a score: all that are not negated, each word on its own."""
    out: list[Term] = []

    def walk(tree) -> None:
        if isinstance(tree, Term):
            out.extend([tree] if tree.exact else [Term(w) for w in tree.text.split()])
        elif not isinstance(tree, Not):
            for p in tree.parts:
                walk(p)

    walk(parse(text))
    return out


def matches_or_contains(query: str, column: Column) -> Column:
    """A query over a text column; one that cannot be parsed is looked for as it stands: a
    quoted text as a whole, wildcards over the whole, anything else anywhere in the text."""
    try:
        return matches(query, scalar_term(column))
    except ValueError:
        text = query.strip()
        if len(text) > 1 and text[0] == text[-1] == '"':
            return F.lower(column) == text[1:-1].lower()
        if "*" in text or "?" in text:
            return column.rlike(wildcard_regex(text))
        return F.lower(column).contains(text.lower())
