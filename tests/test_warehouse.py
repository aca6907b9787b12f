"""The star schema after changes of files, against one built anew."""
import json
import random

import pytest

from shelfmark.sources import warehouse as W


def put(root, path, body):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body if isinstance(body, str) else json.dumps(body))


def bean(rng, owner, i, day):
    return {
        "name": f"{owner} {rng.choice(['Plum', 'Fig', 'Öl'])} {i}", "url": f"https://{owner}/{i}", "weight": str(rng.choice([250, 1000])), "price": str(rng.randrange(8, 40)), "currency": rng.choice(["EUR", "USD", None]),
        "tasting_notes": rng.sample(["plum", "fig", "rose"], 2), "scraped_at": f"2025-01-{day:02}T0{i % 10}:00:00+00:00", "price_options": [{"weight": 250, "price": 10.0 + i}],
        "origins": [{"country": rng.choice(["Colombia", "PE"]), "region": "Huila?", "farm": "Finca La Paz", "process": rng.choice(["Lavado", "honey"]), "elevation_min": "1500"}],
    }


@pytest.fixture
def tree(tmp_path):
    rng, root = random.Random(6), tmp_path / "in"
    for owner in ("acme", "bolt", "cern", "dune"):
        for day in (1, 2):
            for i in range(4 + day):
                put(root, f"{owner}/202501{day:02}/b{i}_101010.json", bean(rng, owner, i, day))
        put(root, f"{owner}/20250102/b1_121212.diffjson", {"url": f"https://{owner}/1", "price": 20, "scraped_at": "2025-01-02T11:00:00+00:00"})
    put(root, "acme/20250101/broken_101010.json", "{not json")
    return root


def dims(spark, process="Washed"):
    frame = spark.createDataFrame
    return W.Dimensions(
        frame([("Colombia", "CO")], "name string, code string"),
        frame([("CO", "Huila?", "Huila")], "country string, region string, state string"),
        frame([("CO", "huila", "la paz", "La Paz")], "country string, region string, alias string, farm string"),
        frame([("EUR", 0.5, 1)], "currency string, rate double, fetched_at int"),
        frame([("lavado", process)], "original_name string, common_name string"),
    )


def content(store):
    """All tables with beans by owner and url instead of numbers."""
    beans = store.table("beans")
    named = {r.id: (r.owner_dir, r.url) for r in beans.select("id", "owner_dir", "url").collect()}
    assert len(named) == beans.count() and len(set(named.values())) == len(named)
    out = {}
    for name in W.STAR:
        key = "id" if name in ("beans", "corpus") else "bean_id"
        out[name] = sorted(((named[r[key]], str({k: v for k, v in r.asDict(True).items() if k != key})) for r in store.table(name).collect()), key=str)
    return out


def test_changes_give_what_a_rebuild_gives(spark, tree, tmp_path):
    rng, store = random.Random(7), W.Warehouse(spark, str(tmp_path / "store"))
    assert store.table("beans") is None
    store.refresh(str(tree), dims(spark))
    first = {(r.owner_dir, r.url): r.id for r in store.table("beans").collect()}
    assert sorted(first.values()) == list(range(1, len(first) + 1))
    assert store.refresh(str(tree), dims(spark)) == []
    put(tree, "bolt/20250103/new_101010.json", bean(rng, "bolt", 77, 3))  # its other beans go out of stock
    put(tree, "acme/20250102/b2_101010.json", bean(rng, "acme", 2, 2))
    put(tree, "acme/20250102/b2_131313.diffjson", {"url": "https://acme/2", "name": "Patched", "scraped_at": "2025-01-02T12:00:00+00:00"})
    (tree / "acme/20250101/b0_101010.json").unlink()
    (tree / "acme/20250102/b0_101010.json").unlink()
    touched = store.refresh(str(tree), dims(spark))
    assert 1 <= len(touched) <= 2
    again = W.Warehouse(spark, str(tmp_path / "again"))
    again.refresh(str(tree), dims(spark))
    got, want = content(store), content(again)
    for name in W.STAR:
        assert got[name] == want[name], name
    rows = {(r.owner_dir, r.url): r for r in store.table("beans").collect()}
    assert ("acme", "https://acme/0") not in rows and rows["acme", "https://acme/2"].name == "Patched" and not rows["bolt", "https://bolt/1"].in_stock
    assert all(rows[k].id == first[k] for k in rows if k in first) and rows["bolt", "https://bolt/77"].id == len(first) + 1
    assert {r.process_common_name for r in store.table("origins").collect()} == {"Washed", None}
    entry = store.state()[1]["tables"]["beans"]["buckets"]
    assert len(set(entry.values())) == 2  # untouched buckets are the files of before


def test_a_failure_in_the_middle_leaves_all_tables(spark, tree, tmp_path, monkeypatch):
    store = W.Warehouse(spark, str(tmp_path / "store"))
    store.refresh(str(tree), dims(spark))
    before = content(store)
    put(tree, "dune/20250103/new_101010.json", bean(random.Random(1), "dune", 9, 3))
    own = store._write
    monkeypatch.setattr(store, "_write", lambda name, *a: own(name, *a) if name != "price_options" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.refresh(str(tree), dims(spark))
    assert content(W.Warehouse(spark, str(tmp_path / "store"))) == before
    monkeypatch.undo()
    assert len(store.refresh(str(tree), dims(spark))) == 1
    assert content(store) != before and store.vacuum() > 0
    assert any("dune/9" in str(r) for r in content(store)["beans"])


def test_mappings_alone(spark, tree, tmp_path):
    store = W.Warehouse(spark, str(tmp_path / "store"))
    store.refresh(str(tree), dims(spark))
    before = content(store)
    for p in tree.rglob("*json"):
        p.unlink()  # no file is needed
    store.recompute(dims(spark, "Clean"))
    after = content(store)
    assert after["beans"] == before["beans"] and after["price_options"] == before["price_options"]
    assert after["origins"] == [(k, r.replace("'Washed'", "'Clean'")) for k, r in before["origins"]]


def test_scratch_folders_go(spark, tmp_path):
    from shelfmark.shared import checkpoint, new_folder, scratch

    with scratch(spark):
        folder = new_folder(spark, "x")
        spark.range(5).write.parquet(folder)
        kept = checkpoint(spark.range(7))
        assert kept.count() == 7
    assert not spark._jvm.java.io.File(folder.removeprefix("file:")).exists()
