"""Queries that must read whole tables: rows beyond small ids, long texts, any language."""
import re
import unicodedata

from shelfmark import plans

QUERIES, ORACLE = plans.collect()


def brute_slug(text):
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[\s-]+", "-", re.sub(r"[^a-z0-9\s-]", "", plain).strip())


def test_slugs_of_whole_texts_in_any_language(spark, tmp_path):
    texts = [("de", "Größe und Straße, ÄÖÜ " * 9), ("en", "a - b--c " * 30 + "end"), (None, "Où, señor?\nÇa va"), ("xx", "!\n Old\tTown \n"), ("fr", None), ("es", ""), ("pl", "Świeży Łódź ő"), ("vi", "Đắk Lắk Tiếng Việt"), ("xx", "ﬁne ½ ㎏ Ⅳ ⑴ 𝔄 한 e\u0301"), ("jp", "ｆｕｌｌ　ｗｉｄｔｈ")]
    rows = [(i, lang, t) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slug for r in QUERIES["slugify"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_slug(t) for i, _, t in rows}


def test_farm_names_and_surnames(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions import text as T

    names = {"Finca Las Flores": "las flores", "Quebraditas Coffee Farm": "quebraditas", "Elora Washing Station": "elora", "  Świeży Café ": "swiezy cafe", "Łódź Estate": "łodz estate", None: None}
    people = {"Edinson Argote & Luz Ángela Rojas": ["edinson", "argote", "luz", "angela", "rojas"], "Lasso Brothers": ["lasso"], "Various smallholder farmers": [], "søren ab x1y2 Nguyễn": ["nguyen"]}
    df = spark.createDataFrame([(n,) for n in names], "t string").select("t", T.bare_name(F.col("t")).alias("out"))
    assert {r.t: r.out for r in df.collect()} == names
    df = spark.createDataFrame([(n,) for n in people], "t string").select("t", T.surnames(F.col("t")).alias("out"))
    assert {r.t: r.out for r in df.collect()} == people
    titles = {"o'neil-smith 3rd ÉCOLE": "o'neil-smith 3rd école".title(), "": "", None: None}
    df = spark.createDataFrame([(n,) for n in titles], "t string").select("t", T.title(F.col("t")).alias("out"))
    assert {r.t: r.out for r in df.collect()} == titles


def test_lookup_and_first_value_beyond_small_ids(spark, tmp_path):
    keys = [1, 2999, 3000, 150_000]
    items = [(k, n, k + n, float(10 * n), float(n % 2)) for k in keys[:3] for n in (1, 2, 3)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    top = {r.o_orderkey: r.top for r in QUERIES["scalar_lookup"](spark, str(tmp_path)).collect()}
    assert top == {1: 30.0, 2999: 30.0, 3000: 30.0, 150_000: None}
    first = sorted((r.l_orderkey, r.l_linenumber, r.first_part) for r in QUERIES["first_value_window"](spark, str(tmp_path)).collect())
    assert first == [(k, n, k + 1) for k in keys[:3] for n in (1, 2, 3)]


def test_zips_and_conflicts_of_parts_beyond_small_ids(spark, tmp_path):
    parts = [(149, "old nut", "TIN"), (150, "red bolt", "TIN"), (299, "red bolt", "STEEL"), (300, "big gear", "TIN"), (90_001, "big gear", "TIN"), (90_003, "big gear", "TIN")]
    spark.createDataFrame([(*p, 1) for p in parts], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    zipped = sorted((r.p_partkey, r.note, r.size) for r in QUERIES["zip_explode"](spark, str(tmp_path)).collect())
    assert zipped == sorted((k, w, len(w)) for k, name, kind in parts for w in f"{name} {kind.lower()}".split())
    conflicts = {r.key: (r.spellings, r.conflict) for r in QUERIES["case_dup_conflicts"](spark, str(tmp_path)).collect()}
    assert conflicts == {"red bolt": (2, True), "big gear": (2, False)}


def test_auc_is_summed_by_ranges_of_scores(spark, tmp_path):
    rows = [(i, i * 7 % 3 % 2, "#" * (i * i % 17) + "a" * (20 + i % 5)) for i in range(60)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = lambda t: t.count("#") / (len(t) + 1)
    good, bad = ([score(t) for _, q, t in rows if q == k] for k in (0, 1))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    df = QUERIES["roc_auc"](spark, str(tmp_path))
    assert df.collect()[0].auc == round(auc, 6)
    plan = df._jdf.queryExecution().toString()
    assert "rangepartitioning(s#" in plan and "windowspecdefinition(s#" not in plan
