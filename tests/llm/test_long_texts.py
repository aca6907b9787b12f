"""Texts of a megabyte and more, repeated rows and clashing names."""
import hashlib

import numpy as np
import pytest

from shelfmark.llm import chat, mixing, packing, quality_model, quality_rules
from shelfmark.llm.tokens import Encoder, default_path

LONG = "it was the end of the day, and so we went on.\n" * 30_000


def test_rules_of_a_long_text(spark):
    df = spark.createDataFrame([(1, LONG, 7), (1, LONG, 7), (2, "w " * 600_000, 8)], "doc_id long, text string, n_words int")
    rows = quality_rules.judge(df.select("doc_id", "text")).collect()
    one = [r for r in rows if r.doc_id == 1]
    words = LONG.split()
    assert len(one) == 2 and all((r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), 29_999, len(words)) for r in one)
    assert all(r.base_failed and not r.kept for r in rows) and quality_rules.keep(df).count() == 0


def test_scores_of_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, LONG, 0.5, "x"), (1, LONG, 0.1, "y"), (2, "", 0.2, None), (3, None, 0.3, None)], "doc_id long, text string, score double, label string")
    size = quality_model.BUCKETS + quality_model.STATISTICS
    machine = quality_model.Machine(0.1, np.linspace(-0.1, 0.1, size), np.zeros((size, quality_model.FACTORS)))
    got = sorted((r.doc_id, r.score) for r in quality_model.score(docs, machine).collect())
    b, s = quality_model.describe(LONG)
    want = float(machine.scores([b], np.array([s], np.float64))[0])
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0][1] == got[1][1] == pytest.approx(want) and got[2][1] == got[3][1]


def test_a_long_turn(spark, tmp_path):
    df = chat.text_parts(spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string"), "text")
    r = chat.digests(chat.render(df, str(tmp_path / "o"))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(LONG), hashlib.sha256(LONG.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{LONG}\n".encode()).hexdigest()


def test_a_long_text_is_packed_in_pieces(spark):
    docs = spark.createDataFrame([(1, LONG, 1), (1, LONG, 2), (2, "short", 3)], "doc_id long, text string, piece int")
    rows = packing.pack(docs.where("piece <> 2")).collect()
    n = int(Encoder(default_path()).encode([LONG])[1][0]) + 1
    own = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert sum(r.length for r in own) == n and [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    assert all(r.length == 2048 for r in own[1:]) and sum(r.length for r in packing.pack(docs).where("doc_id = 1").collect()) == 2 * n


def test_names_in_use_are_refused(spark):
    with pytest.raises(ValueError, match="_mix_x"):
        mixing.mix(spark.createDataFrame([(1, "a", "s", 1)], "doc_id long, text string, source string, _mix_x int"))
