"""Counts against the library's own of whole texts."""
import random

import pytest
from tokenizers import Tokenizer, normalizers

from shelfmark.llm import token_counts
from shelfmark.llm.tokens import default_path

FILE = Tokenizer.from_file(default_path())


def whole(text):
    return len(FILE.encode(text or "", add_special_tokens=False).ids)


def huge_texts():
    rng = random.Random(13)
    pieces = ["a", "word", " ", "   ", "\n\n", "\t", ".", "...", "'re", "'", "'ll", "\xe9", "　", "漢字", "\U0001f642", "12", "<|endoftext|>", "<|endof", "text|>", " the", "\r\n", "x" * 30]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randrange(50, 900))) for _ in range(40)]
    runs = ["q" * 3000, "ab" * 700 + " " + "cd" * 900, " " * 2500, "<|endoftext|>" * 200, "'re" * 900, "word " * 800, "1" * 1500 + "\n" * 1500]
    return mixed + runs


@pytest.mark.parametrize("unit, fan", [(16, 2), (37, 3), (64, 4)])
def test_counts_equal_those_of_whole_texts(spark, monkeypatch, unit, fan):
    monkeypatch.setattr(token_counts, "UNIT", unit)
    monkeypatch.setattr(token_counts, "FAN", fan)
    texts = [None, "", "a", *huge_texts(), "same " * 400, "same " * 400]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (0, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), whole(t), whole(t) > 512) for i, t, *_ in rows), key=str)
    assert got == want


def test_chunks_are_spliced_and_widened():
    text = "one two three four five six seven"
    assert token_counts.splice(FILE, text, 10, 4) is not None
    assert token_counts.splice(FILE, "x" * 60, 30, 4) is None
    for core in range(1, 24):  # a boundary is stable: both parts sum up to the whole
        n = token_counts.splice(FILE, text, core, 4)
        if n is not None:
            assert n + whole(text[core:]) == whole(text)


def test_a_text_of_megabytes_with_one_word_that_no_overlap_holds(spark):
    text = "the end of it, we'll see. " * 60_000 + "z" * 9_000 + " and so on" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count(docs).collect()}
    assert got == {1: (len(text), whole(text)), 2: (5, whole("short"))}


def test_files_of_another_kind_and_empty_tables(spark, tmp_path):
    file = Tokenizer.from_file(default_path())
    file.normalizer = normalizers.Lowercase()
    file.save(str(tmp_path / "lower.json"))
    text = "The End. THE end " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = token_counts.count(docs, path=str(tmp_path / "lower.json")).first()
    assert got.n_tokens == len(file.encode(text, add_special_tokens=False).ids)
    assert token_counts.count(docs.limit(0)).count() == 0


def test_whole_table(spark):
    got = {r.doc_id: r for r in token_counts.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens) == (len((d.text or "").encode()), whole(d.text))
