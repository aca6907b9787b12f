import glob
import hashlib
import random
import tarfile
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, normalizers

import corpus_pipeline
from shelfmark.llm import media, packing, quality_model, token_store
from shelfmark.llm.tokens import Encoder, default_path

TEXTS = [None, "", "a", "it's  we'll\n\n x ", "word. Word, end!\nNext\n", "naïve café ü ß 日本", "the of and " * 3000, "the of and " * 3000, "\x00 a\x00 b", "1st 2nd 3.14 +1 (487)", " lead\n trail\n"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts)], "doc_id long, text string, source string, row int").repartition(3)


def ids_of(text):
    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids


def test_segments_encode_as_whole_texts_do():
    ids, counts = Encoder(default_path()).encode([t or "" for t in TEXTS])
    assert np.split(ids, np.cumsum(counts))[:-1] and [list(x) for x in np.split(ids, np.cumsum(counts))[:-1]] == [ids_of(t) for t in TEXTS]


def test_segments_of_odd_texts():
    rng, file = random.Random(5), Tokenizer.from_file(default_path())
    pieces = ["a", "b", " ", "  ", "\n", "\t", ".", ",", "\xe9", "\xdf", "\xd7", "\u3000", "\u180e", "\x85", "\x00", "\x1c", "\u6f22", "\ud55c", "\U0001f642", "1", "23", "'s", "'", "<|endoftext|>", "_", "\r", "Word", " the"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(5000)] + ["", None, "x" * 100_000]
    ids, counts = Encoder(default_path()).encode(texts)
    want = [e.ids for e in file.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == want


def test_files_of_another_kind_encode_whole_texts(tmp_path):
    file = Tokenizer.from_file(default_path())
    file.normalizer = normalizers.Lowercase()
    file.save(str(tmp_path / "lower.json"))
    texts = ["The End. THE end", "", None, " A  b\nC"]
    ids, counts = Encoder(str(tmp_path / "lower.json")).encode(texts)
    want = [file.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == want


def test_token_store_round_trip(spark, tmp_path):
    folder = str(tmp_path / "store")
    token_store.write(frame(spark), folder)
    start = 0
    whole = {r.doc_id: r for r in token_store.read(spark, folder).collect()}
    sums = {r.doc_id: r for r in token_store.checksums(spark, folder).collect()}
    for i, t in enumerate(TEXTS):
        own = np.array([*ids_of(t), 2], "<u4")
        assert bytes(whole[i].ids) == own.tobytes()
        assert (sums[i].start, sums[i].n_tokens, sums[i].ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    chunks = spark.read.parquet(f"{folder}/packed").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_of_a_whole_table_gives_every_document_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 4096)
    monkeypatch.setattr(token_store, "FANOUT", 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long_ = spark.createDataFrame([(10**9, "the end " * 250_000), (10**9 + 1, None)], "doc_id long, text string")
    docs, folder = docs.select("doc_id", "text").unionByName(long_), str(tmp_path / "store")
    token_store.write(docs, folder)
    file = Tokenizer.from_file(default_path())
    want = {r.doc_id: np.array([*file.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    got = {r.doc_id: r for r in token_store.read(spark, folder).collect()}
    sums = {r.doc_id: r for r in token_store.checksums(spark, folder).collect()}
    assert got.keys() == want.keys() == sums.keys()
    start = 0
    for i in sorted(want):
        own = want[i].tobytes()
        assert bytes(got[i].ids) == own and (got[i].start, got[i].n_tokens) == (start, len(want[i]))
        assert (sums[i].start, sums[i].n_tokens, sums[i].ids_crc32) == (start, len(want[i]), zlib.crc32(own))
        start += len(want[i])
    tree = spark.read.parquet(f"{folder}/manifest").collect()
    top = max(r.level for r in tree)
    assert top >= 3 and [r.n_docs for r in tree if r.level == top] == [len(want)]
    assert all(sum(r.n_docs for r in tree if r.level == k) == len(want) for k in range(top + 1))


def test_damaged_store_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "store")
    token_store.write(frame(spark), folder)
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("root", manifest_root())
    bad = str(tmp_path / "bad")
    token_store._packed(spark, folder).write.partitionBy("kind").parquet(f"{bad}/packed")
    spark.read.parquet(f"{folder}/recipes").write.parquet(f"{bad}/recipes")
    manifest.write.parquet(f"{bad}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify_manifest(spark, bad)


def manifest_root():
    from pyspark.sql import functions as F

    return F.lit("0")


def test_crc_of_parts_is_that_of_the_whole():
    raw = bytes(range(256)) * 9
    parts = [raw[:5], raw[5:1000], raw[1000:]]
    after = np.array([len(raw) - 5, len(raw) - 1000, 0])
    shifted = token_store.crc_shifted(np.array([zlib.crc32(p) for p in parts], np.uint64), after)
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(raw)


def test_media_round_trip(spark, tmp_path):
    folder, texts = str(tmp_path / "media"), TEXTS + ["\0" * 64, "a\0", "a", "long " * 300_000]
    df = frame(spark, texts)
    rows, index = media.store(df.unionByName(df.where("doc_id in (2, 5)")), folder)
    distinct = {media.payload(t) for t in texts}
    assert index.count() == len(distinct)  # one for each payload
    members = [m.name for f in glob.glob(f"{folder}/*.tar") for m in tarfile.open(f)]
    assert sorted(members) == sorted(f"{hashlib.sha256(p).hexdigest()}.png" for p in distinct)
    every = rows.join(media.features(index, folder), "digest").join(media.metadata(index, folder), "digest").collect()
    assert len(every) == len(texts) + 2
    for r in every:
        data = media.payload(texts[r.doc_id])
        stored = open(f"{folder}/{r.shard}", "rb").read()[r.start : r.start + r.length]
        samples = np.frombuffer(data, np.uint8)
        assert media.decode_png(stored) == data and media.decode_png(media.encode_png(data)) == data
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(data), hashlib.sha256(data).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.width, r.height, r.bits) == (64, len(data) // 64, 8)
        assert r.feature == f"64x{len(data) // 64}x8:{int(samples.sum(dtype=np.int64))}:{samples.max()}:{len(set(data))}"
    assert media.store(df.limit(0), folder)[0].count() == 0


def test_packing_places_every_piece_without_gaps(spark):
    df = frame(spark, TEXTS + ["x y z " * n for n in (1, 5, 50, 700, 700, 1365)])
    packed = packing.pack(df, keep_ids=True)
    rows = packed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert total == sum(len(ids_of(t)) + 1 for t in [r[1] for r in df.collect()])
    assert len(by) <= -(-total // 2048) + 1
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, parts in by.items():
        own = b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.offset))
        assert bytes(whole[s].ids) == own and whole[s].length * 4 == len(own)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [7, 20, 2048])
def test_plans_hold_every_item_once(capacity):
    rng = np.random.default_rng(capacity)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(rng.integers(1, capacity + 1, 3000), return_counts=True))}
    got = {}
    for pattern, times in packing.plan_bins(histogram, capacity):
        assert sum(pattern) <= capacity and sum(n * 3 > capacity for n in pattern) <= 2
        for n in pattern:
            got[n] = got.get(n, 0) + times
    assert got == histogram


def test_machine_uses_pairs_and_is_linear():
    m = quality_model.Machine(0.5, np.arange(quality_model.BUCKETS + 10) / 1e5, np.random.default_rng(0).normal(size=(quality_model.BUCKETS + 10, 3)))
    b, s = quality_model.describe("some words here, and Some more")
    index, value, _ = quality_model._flat([b], s[None])
    pairs = sum(m.vectors[i] @ m.vectors[j] * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[:a])
    assert np.isclose(m.margins([b], s[None])[0], 0.5 + m.weights[index] @ value + pairs)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    got = entry.queries()["op6_quality_model"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    x = got.merge(labels, on="doc_id")
    x = x[x.held_out]
    assert (x.predicted == x.quality).mean() > 0.88 and got.score.between(0, 1).all() and len(got) == 1000


def test_degenerate_fits_and_texts(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    m = quality_model.fit(docs, labels)
    assert {round(r.score, 6) for r in quality_model.score(docs, m).collect()} == {0.75}
    assert quality_model.score(docs.limit(0), m).count() == 0


def test_pipeline_keeps_columns_and_runs(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0 and packed.count() > 100
