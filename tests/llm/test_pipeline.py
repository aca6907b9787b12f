"""The pipeline's rows against a brute-force version in plain Python."""
import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline
from shelfmark.llm.quality_rules import EDGES, STOP_WORDS
from test_joins_and_mixes import brute_components
from test_stores_and_models import ids_of
from test_text_operators import PATTERNS, repeats, valid

FOLDER = "/root/testdata/sf0.001"


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if n < 50 or 100 * repeats(w) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda k: k / n
    return (
        2 <= share(sum(map(len, w))) <= 15
        and share(sum(c in "#*$%&|<>" for c in text)) <= 0.1
        and share(sum(x.strip(EDGES).lower() in STOP_WORDS for x in w)) >= 0.08
        and share(sum(x != x.lower() and x == x.upper() and len(x) > 1 for x in w)) <= 0.3
        and 1 - len(set(lines)) / len(lines) <= 0.4
    )


def redacted(text):
    base = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]
    secrets = [(m.start(), m.end(), "secret") for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}", text) if len(re.findall("[0-9]", m[0])) >= 6 and len(re.findall("[A-Za-z]", m[0])) >= 4]
    spans = sorted(base + [x for x in secrets if not any(b[0] < x[1] and x[0] < b[1] for b in base)])
    out, at = "", 0
    for a, z, k in spans:
        if a >= at:
            out += f"{text[at:a]}<{k.upper()}>"
        at = max(at, z)
    return out + text[at:]


def targets(sizes):
    """Shares by weight with caps at three times a source, shared again step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(i % 3 + 1) for i, s in enumerate(order)}
    got, capped, rest = {}, set(), Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 3 * sizes[s]]
        for s in free:
            got[s] = rest * weight[s] / total
        if not over:
            return got
        for s in over:
            got[s] = Fraction(3 * sizes[s])
            capped.add(s)
            rest -= got[s]


def test_pipeline_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if good(r.text)]
    label = brute_components([(r.doc_id, r.text) for r in docs], 5, Fraction(4, 5))
    rows = [(r.doc_id, r.source, redacted(r.text)) for r in docs if label[r.doc_id][1] == r.doc_id]
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, _, t in rows}
    sizes = Counter()
    for d, s, _ in rows:
        sizes[s] += words[d]
    target, place = targets(sizes), defaultdict(int)
    wanted = Counter()
    for d, s, t in sorted(rows, key=lambda r: ((r[1] is None, r[1]), hashlib.md5(str(r[0]).encode()).hexdigest())):
        copies = sum(2 * (k * sizes[s] + place[s]) + words[d] < 2 * target[s] for k in range(3))
        place[s] += words[d]
        n, start = len(ids_of(t)) + 1, 0
        length = n % 2048 or 2048
        while start < n:
            wanted[(d, start, length)] += copies
            start, length = start + length, 2048
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.start, r.length) for r in got) == +wanted
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * sum(ends.values()) / 2048 + 1


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark):
    text = "the and of is " + " ".join(f"word{i} of" for i in range(60)) + " mail a@b.cd 0c497b5014f705c0be648d68b816f88c20"
    rows = [(1, text, "en", None, 5, "x", 7), (1, text, "en", None, 5, "x", 7), (2, text + " end", None, "s", None, None, None), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "y", 1), (None, text.replace("word", "term"), "en", "s", 1, "z", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"
    for df in (spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], schema)):
        found = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, FOLDER)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name
            held = out.collect()
            found.append(len(held))
            df = spark.createDataFrame(held, out.schema)
        if found[0]:
            # Two rows are empty; three of the other four are near copies of the first, or repeat it.
            assert found[:3] == [4, 2, 2] and found[4] >= found[3] > 0
        else:
            assert found == [0] * 5
