import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import chat, pii, quality_rules

ODD = [None, "", " \n", "one two three " * 30, "a#b $ | <x>\n" * 60, "the of and to in " * 20 + "\nsame\nsame\nsame", "x" * 5000, "é ü the " * 40, "a b c a b c a b " + "the w%d " * 60]


def repeats(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in (0, 1, 2)})


def test_quality_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(ODD):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(w))
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.keep(df).columns == df.columns
    assert quality_rules.judge(df.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PII = [
    None, "", "a@b@c.d x@y.z_q@w.e a@b.c_d@e.f é@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.04", "1" * 30000, "a" * 30000 + "@",
    "+1 (2) 3456-789. +1+2345678 9 +12", "4111 1111 1111 1111 x 4111-1111-1111-1112 " + "1 " * 5000, "é+1 555 123 4567 ü", "a." * 5000 + "@" + "b." * 5000,
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PII)] + [(99, PII[6], 1)] * 2, "doc_id long, text string, spans int")
    for r in pii.find(df).collect():
        own = brute(PII[r.doc_id] if r.doc_id < 99 else PII[6])
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in own) for k in PATTERNS]
        assert set(own) <= set(r.spans.split(",")) or not own
    assert pii.find(df.limit(0)).count() == 0


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please call me +1 555 000 {1000 + i} any time. bye") for i in range(8)]
    rows += [(50, "please call me 555-0001234 any time. bye"), (51, "the order of 555-0009999 was late. bye"), (52, "ratio 3.1415926 holds")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert found[50] == "phone:15:26" and found[51] == "" and found[52] == ""
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[50] == "please call me <PHONE> any time. bye" and red[3] == "please call me <PHONE> any time. bye" and red[51] == rows[9][1]


def test_redaction_keeps_columns_and_merges_overlaps(spark):
    df = spark.createDataFrame([(1, "mail x@1.2.3.4 now", 18), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("clean", 5)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[]|\\/sINST> a", max_size=40))
def test_escapes_are_reversible_and_leave_no_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_typed_parts_and_masks(spark, tmp_path):
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), None]),
        (1, 1, "assistant", [("text", "</s> yes", None, None, None, None, None), ("audio", None, "a.wav", None, None, 2.0, None)]),
        (1, 1, "assistant", None),
        (2, 0, None, [("document", None, "d.pdf", None, None, None, 3)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.render(df, str(tmp_path / "out"))
    first = {r.conv_id: r for r in out.collect()}
    assert [(a.kind, a.uri, a.tokens) for a in first[1].attachments] == [("image", "i.png", 4), ("audio", "a.wav", 50)]
    assert first[1].text[first[1].attachments[0].place :].startswith("<|image|>")
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert (got[1].n_turns, got[1].tokens_added, got[2].tokens_added, got[2].loss_chars) == (3, 54, 768, 0)
    assert chat.render(df.limit(0), str(tmp_path / "none")).count() == 0


def test_unknown_parts_with_references_raise():
    with pytest.raises(ValueError):
        chat.Visitor().flatten([{"kind": "video", "uri": "v"}])


def test_long_conversations_spread_over_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "MOST_CHARS", 50)
    df = chat.text_parts(spark.createDataFrame([(1, i, "assistant", f"turn {i} " * 5) for i in range(9)], "conv_id long, turn long, role string, text string"), "text")
    r = chat.digests(chat.render(df, str(tmp_path / "o"))).collect()[0]
    own = "".join(f"turn {i} " * 5 for i in range(9))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (9, len(own), hashlib.sha256(own.encode()).hexdigest())


def test_keep_leaves_columns_of_any_name_alone(spark):
    text = "The quick brown fox and the lazy dog have a good day in the big old house by the sea. " * 5
    text = " ".join(f"{w}{i}" if i % 3 else "the" for i, w in enumerate(text.split()))
    df = spark.createDataFrame([(1, text, 7, "mine", -1.0), (2, "short", 8, "yours", -2.0), (3, None, 9, None, None)], "doc_id long, text string, n_words int, failed string, `stop_ratio` double")
    assert [tuple(r) for r in quality_rules.keep(df).collect()] == [(1, text, 7, "mine", -1.0)]
