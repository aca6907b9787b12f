import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import etl
from shelfmark.sources import catalogue as C


@pytest.fixture
def tree(tmp_path):
    def put(path, body):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body if isinstance(body, str) else json.dumps(body))

    bean = {"name": "Öl", "url": "u1", "weight": "249.6", "price": "18", "currency": "EUR", "tasting_notes": ["plum", "fig"], "scraped_at": "2025-01-01T00:00:00+00:00"}
    origin = {"country": "Colombia", "region": "Huila?", "farm": "Finca La Paz", "elevation_min": "2000", "elevation_max": "1500.4"}
    put("in/acme/20250101/one_101010.json", bean)
    put("in/acme/20250102/one_111111.json", {**bean, "name": "Öl 2", "scraped_at": "2025-01-02T00:00:00+00:00", "origins": [origin, origin], "price_options": [{"weight": 250, "price": 18.0}], "unknown": 1})
    put("in/acme/20250101/two_101010.json", {"name": "Two", "url": "u2", "scraped_at": "2025-01-01T00:00:00+00:00"})
    put("in/acme/20250101/nameless_101010.json", {"url": "u3"})
    put("in/acme/20250101/broken_101010.json", "{not json")
    put("in/acme/20250102/one_121212.diffjson", {"url": "u1", "price": 20, "scraped_at": "2025-01-02T01:00:00+00:00"})
    put("in/acme/20250102/two_121212.diffjson", {"url": "u2", "in_stock": True, "price": 9999})
    put("maps/CO.json", {"Huila?": {"canonical_state": "Huila", "confidence": 1.0}, "Nowhere": None})
    put("farms.json", [{"country": "CO", "region": "huila", "canonical_farm_name": "La Paz", "normalized_farm_names": ["la paz", "lapaz"]}])
    put("rates.json", {"base": "USD", "rates": {"EUR": 0.5}})
    return tmp_path


def test_snapshots_become_a_star_schema(spark, tree):
    raw = C.snapshots(spark, str(tree / "in"))
    assert raw.count() == 4  # the broken file gives no row
    beans = etl.beans(raw)
    rows = {r.url: r for r in beans.collect()}
    assert set(rows) == {"u1", "u2"}
    one = rows["u1"]
    assert (one.name, one.name_unaccented, one.weight, one.in_stock, one.clean_url_slug) == ("Öl 2", "Ol 2", 250, True, "one")
    assert (str(one.date_added), rows["u2"].in_stock, list(one.tasting_notes)) == ("2025-01-01 00:00:00", False, ["plum", "fig"])
    countries = spark.createDataFrame([("Colombia", "CO")], "name string, code string")
    found = etl.origins(beans, countries, C.region_mappings(spark, str(tree / "maps")), C.farm_mappings(spark, str(tree / "farms.json"))).collect()
    assert len(found) == 1  # equal origins count once
    o = found[0]
    assert (o.country, o.state_canonical, o.farm_canonical, o.elevation_min, o.elevation_max) == ("CO", "Huila", "La Paz", 1500, 2000)
    rates = C.rates(spark, str(tree / "rates.json"), "2025-01-01")
    patched = {r.url: r for r in etl.with_base_price(etl.patched(beans, C.patches(spark, str(tree / "in"))), rates).collect()}
    assert (patched["u1"].price, patched["u1"].price_usd) == (20.0, 40.0)
    assert patched["u2"].in_stock is False  # its patch is out of bounds and skipped as a whole
    assert [(r.price_per_kg, r.price_per_kg_usd) for r in etl.price_options(beans, rates).collect()] == [(72.0, 144.0)]
    text = {r.id: r for r in etl.corpus(beans, etl.origins(beans, countries, C.region_mappings(spark, str(tree / "maps")), C.farm_mappings(spark, str(tree / "farms.json")))).collect()}
    assert text[one.id].notes == "plum fig" and text[one.id].state_canonical == "Huila"


def test_ledger_lists_new_and_changed_files(spark, tree):
    folder = str(tree / "in")
    listed = C.unprocessed(spark, folder, "*.json", None)
    ledger = spark.createDataFrame(listed.collect(), listed.schema)
    assert ledger.count() == 5 and C.unprocessed(spark, folder, "*.json", ledger).count() == 0
    (tree / "in/acme/20250101/two_101010.json").write_text("{}")
    assert C.unprocessed(spark, folder, "*.json", ledger).count() == 0
    assert C.unprocessed(spark, folder, "*.json", ledger, by_content=True).count() == 1


def test_empty_lists_and_invalid_regions(spark, tree):
    assert C.snapshots(spark, []).count() == 0
    m = {r.region: r.state for r in C.region_mappings(spark, str(tree / "maps")).collect()}
    assert m == {"Huila?": "Huila", "Nowhere": None}


def test_log_days(spark, tmp_path):
    (tmp_path / "a.log").write_text("noise\n=== 2025-01-01\nFAIL x\nOK x\nFAIL y\n=== 2025-01-02\nFAIL x\n")
    got = sorted(map(tuple, C.failed_days(spark, str(tmp_path / "a.log")).collect()))
    assert got == [("x", "2025-01-01", False), ("x", "2025-01-02", True), ("y", "2025-01-01", True)]


def test_mapping_and_media(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"k": "a", "v": "1", "n": 1}, {"k": "a", "v": "2", "n": 2}]))
    assert [r.v for r in C.mapping(spark, str(tmp_path / "m.json"), "k string, v string, n int", "k", "n").collect()] == ["2"]
    (tmp_path / "show_one").mkdir()
    (tmp_path / "show_one/e1_analysis.json").write_text(json.dumps({"episode_title": "E", "segments": [{"title": "s", "entities": [{"raw_name": "q"}]}]}))
    t = C.media_tables(C.media(spark, str(tmp_path / "show_one")))
    assert t["episodes"].collect()[0].podcast_name == "show one"
    assert [r.entity_id for r in t["entities"].collect()] == ["e1_0_0"]
    assert t["segments"].select(F.col("episode_id")).collect()[0][0] == "e1"


def test_refresh_reads_only_what_changed(spark, tree):
    folder = str(tree / "in")
    raw, ledger = C.refreshed(spark, folder)
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)
    raw, ledger = kept(raw), kept(ledger)
    new = {"name": "Three", "url": "u4", "scraped_at": "2025-01-03T00:00:00+00:00"}
    (tree / "in/acme/20250103").mkdir()
    (tree / "in/acme/20250103/three_101010.json").write_text(json.dumps(new))
    (tree / "in/acme/20250101/two_101010.json").write_text(json.dumps({**new, "name": "Two!", "url": "u2"}))
    (tree / "in/acme/20250101/one_101010.json").unlink()
    # A row that no file has any more tells what was kept and what was read again.
    marked = raw.withColumn("description", F.lit("kept"))
    after, now = C.refreshed(spark, folder, marked, ledger)
    rows = sorted((r.filename.rpartition("/")[2], r.description) for r in after.collect())
    assert rows == [("nameless_101010.json", "kept"), ("one_111111.json", "kept"), ("three_101010.json", None), ("two_101010.json", None)]
    assert sorted(map(tuple, etl.beans(after).select("url", "name").collect())) == sorted(map(tuple, etl.beans(C.refreshed(spark, folder)[0]).select("url", "name").collect()))
    again, _ = C.refreshed(spark, folder, kept(after), kept(now))
    assert again.count() == 4 and C.snapshots(spark, [str(tree / "in/acme/20250103/three_101010.json")]).first().name == "Three"


def test_farm_names_are_normalised_when_read(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"country": "CO", "region": "huila", "canonical_farm_name": "La Paz", "normalized_farm_names": ["la paz"], "original_farm_names": ["Finca La Paz", "La Páz Coffee Farm", "Lapaz "]}]))
    assert sorted(r.alias for r in C.farm_mappings(spark, str(tmp_path / "f.json")).collect()) == ["la paz", "lapaz"]


def test_patch_days_and_dimensions(spark, tree):
    assert [tuple(r) for r in C.patch_days(spark, str(tree / "in")).collect()] == [("acme", "20250102")]
    (tree / "d.csv").write_text("a,code\n1,007\n2,\n")
    assert [tuple(r) for r in C.dimension(spark, str(tree / "d.csv"), "a int, code string").collect()] == [(1, "007"), (2, None)]


def test_audio_merge_and_sorted_files(spark, tmp_path):
    e = spark.createDataFrame([("a", "podcast", None), ("b", "podcast", 5), ("c", "video", None)], "id string, media_type string, seconds int")
    audio = spark.createDataFrame([("a", 7), ("b", None), ("c", 9)], "id string, seconds int")
    assert sorted(tuple(r) for r in C.with_audio(e, audio, ["seconds"], "podcast").fillna(-1).collect()) == [("a", "podcast", 7), ("b", "podcast", 5), ("c", "video", -1)]
    texts = []
    for n in (1, 4):
        C.written_sorted(e.repartition(n), str(tmp_path / f"o{n}"), ["id"])
        texts.append("".join(p.read_text() for p in sorted((tmp_path / f"o{n}").glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].splitlines()[0] == '{"id":"a","media_type":"podcast","seconds":null}'


def test_rows_break_the_bounds_they_break(spark, tmp_path):
    from shelfmark.operators.quality import violations

    rows = [
        {"name": "a", "price": "-1", "weight": "49", "cupping_score": 69.5, "origins": [{"elevation_min": "3001", "latitude": "91", "longitude": "-181"}]},
        {"name": "b", "price": "0", "weight": "10000", "cupping_score": 100, "origins": [{"elevation_min": "0", "elevation_max": None, "latitude": "x"}, {}]},
        {"name": "c", "tasting_notes": [" plum ", "PLUM", "", "green apple", None]},
    ]
    for r in rows:
        (tmp_path / f"o/20250101/{r['name']}_101010.json").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"o/20250101/{r['name']}_101010.json").write_text(json.dumps(r))
    raw = C.snapshots(spark, str(tmp_path)).select("name", violations(etl.row_rules()).alias("broken"), etl.clean_notes(F.col("tasting_notes")).alias("notes"))
    got = {r.name: (r.broken, r.notes) for r in raw.collect()}
    assert got == {"a": (["price", "weight", "cupping_score", "elevation", "latitude", "longitude"], None), "b": ([], None), "c": ([], ["Plum", "Green Apple"])}


def test_open_notes_and_registered_values(spark, tmp_path):
    lines = ["tasting_note,tertiary_category,secondary_category,primary_category,confidence", "Plum , Stone,Fruit,Sweet,0.9", "fig,Dried,Fruit,,0.8", "tar,x,y,z,0.7", "smoke,x,y,z,none", '"a, b",Stone,,,1']
    (tmp_path / "n.csv").write_text("\n".join(lines))
    done = spark.createDataFrame([("Fruit",), ("other",)], "note string")
    assert sorted(r.note for r in C.open_notes(spark, str(tmp_path / "n.csv"), done).collect()) == ["Dried", "Plum", "Stone", "Sweet", "a, b", "fig"]
    rows, places = spark.createDataFrame([("r1", "DE"), ("r2", None)], "name string, code string"), spark.createDataFrame([("DE",), ("FR",)], "alpha string")
    assert C.registered(rows, "code", places, "alpha").count() == 2
    with pytest.raises(ValueError, match="XX"):
        C.registered(rows.union(spark.createDataFrame([("r3", "XX")], rows.schema)), "code", places, "alpha")
