"""From snapshot files to a star schema, as pure functions of frames.

raw -> beans (latest version per owner and url, with stock state) -> origins and price
options (exploded) -> canonical names (joins) -> prices in the base currency -> patches
-> search corpus. Country names become codes before regions are mapped, so that a row
with a full country name gets its canonical region too.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import bare_name, fold, slug, title
from shelfmark.operators.money import to_base_for_load, with_rate
from shelfmark.operators.versions import apply_patches, latest_by, stock_status, surrogate_ids

#: Fields that a patch may change.
PATCHED = ["name", "roast_level", "roast_profile", "price", "weight", "currency", "is_decaf", "cupping_score", "description", "in_stock", "is_tasting_kit", "requires_review", "tasting_notes"]


def whole(text: str):
    """A whole number from text, half to even; null if it is no number."""
    return F.rint(F.col(text).try_cast("double")).cast("int")


def beans(raw: DataFrame, patch_days: DataFrame | None = None) -> DataFrame:
    """One row per owner and url, as ``bean_rows`` makes them, numbered by name."""
    return surrogate_ids(bean_rows(raw, patch_days), ["name", "owner_dir", "url"], "id")


def bean_rows(raw: DataFrame, patch_days: DataFrame | None = None) -> DataFrame:
    """One row per owner and url: the newest version, first_seen as date_added, in_stock
    if the owner's latest day has it. Rows without a url or name are left out."""
    rows = raw.where((F.coalesce("url", F.lit("")) != "") & F.col("name").isNotNull())
    rows = rows.withColumn("at", F.col("scraped_at").try_cast("timestamp").cast("timestamp_ntz"))
    newest = latest_by(rows, ["owner_dir", "url"], ["scrape_date", "at", "filename"])
    stock = stock_status(rows, "owner_dir", "url", "scrape_date", "at", patch_days)
    leaf = F.regexp_replace(F.regexp_replace(F.split_part("filename", F.lit("/"), F.lit(-1)), r"\.json$", ""), r"_\d{6}$", "")
    return newest.drop("in_stock").join(stock, ["owner_dir", "url"]).select(
        "owner_dir",
        "url",
        "name",
        F.coalesce("roaster", "owner_dir").alias("roaster"),
        "roast_level",
        "roast_profile",
        whole("weight").alias("weight"),
        F.col("price").try_cast("double").alias("price"),
        "currency",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_single_origin", "is_decaf", "is_tasting_kit", "requires_review")],
        "cupping_score",
        "tasting_notes",
        "description",
        "in_stock",
        F.col("at").alias("scraped_at"),
        F.col("first_seen").alias("date_added"),
        leaf.alias("clean_url_slug"),
        F.concat(F.lit("/"), F.col("owner_dir"), F.lit("/"), leaf).alias("bean_url_path"),
        fold(F.col("name")).alias("name_unaccented"),
        "origins",
        "price_options",
    )


def row_rules() -> list[tuple[str, Column]]:
    """What a snapshot's row must keep to (names and conditions, for ``quality.violations``);
    nulls keep to all, and so do heights of 0, which stand for unknown ones."""
    number = lambda c: F.col(c).try_cast("double")
    heights = F.transform("origins", lambda o: F.array(o["elevation_min"].try_cast("double"), o["elevation_max"].try_cast("double")))
    places = lambda field, most: F.forall("origins", lambda o: F.coalesce(o[field].try_cast("double").between(-most, most), F.lit(True)))
    return [
        ("price", number("price") >= 0),
        ("weight", number("weight").between(50, 10_000)),
        ("cupping_score", F.col("cupping_score").between(70, 100)),
        ("elevation", F.forall(F.flatten(heights), lambda h: F.coalesce(h.between(0, 3000), F.lit(True)))),
        ("latitude", places("latitude", 90)),
        ("longitude", places("longitude", 180)),
    ]


def clean_notes(notes: Column) -> Column:
    """Notes without blanks at their ends, in title case, each once in order; null if none."""
    cleaned = F.array_distinct(F.filter(F.transform(notes, lambda n: title(F.btrim(n))), lambda n: n.isNotNull() & (n != "")))
    return F.when(F.size(cleaned) > 0, cleaned)


def origins(beans: DataFrame, countries: DataFrame, regions: DataFrame, farms: DataFrame) -> DataFrame:
    """One row per distinct origin of a bean, with canonical region and farm.
    ``countries``: name, code. ``regions``: country, region, state (a null state marks an
    invalid region). ``farms``: country, region (slug), alias, farm."""
    rows = beans.select(F.col("id").alias("bean_id"), F.explode("origins").alias("o")).select("bean_id", "o.*").distinct()
    names = countries.select(F.lower("name").alias("_name"), F.col("code").alias("_code"))
    rows = rows.join(names, F.lower("country") == F.col("_name"), "left").withColumn("country", F.coalesce("_code", "country")).drop("_name", "_code")
    known = regions.withColumn("_known", F.lit(True))
    rows = rows.join(known, ["country", "region"], "left")
    state = F.when(F.col("_known"), F.col("state")).otherwise(F.col("region"))
    rows = rows.withColumn("state_canonical", state).drop("_known", "state")
    rows = rows.withColumns({"state_canonical_slug": slug(F.col("state_canonical")), "_alias": bare_name(F.col("farm"))})
    f = farms.select(F.col("country"), F.col("region").alias("state_canonical_slug"), F.col("alias").alias("_alias"), F.col("farm").alias("farm_canonical"))
    rows = rows.join(f, ["country", "state_canonical_slug", "_alias"], "left")
    low, high = whole("elevation_min"), whole("elevation_max")
    swap = (low > high) & (low > 0) & (high > 0)
    return rows.select(
        "bean_id",
        "country",
        "region",
        slug(F.col("region")).alias("region_normalized"),
        "producer",
        "farm",
        slug(F.col("farm")).alias("farm_normalized"),
        F.when(swap, high).otherwise(low).alias("elevation_min"),
        F.when(swap, low).otherwise(high).alias("elevation_max"),
        "process",
        "variety",
        "state_canonical",
        "state_canonical_slug",
        "farm_canonical",
    )


def with_mapped(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Adds the common name (mapping: original_name, common_name), whatever the case."""
    m = mapping.select(F.lower("original_name").alias("_k"), F.col("common_name").alias(out)).dropDuplicates(["_k"])
    return df.withColumn("_k", F.lower(column)).join(m, "_k", "left").drop("_k")


def with_base_price(beans: DataFrame, rates: DataFrame) -> DataFrame:
    priced = with_rate(beans, rates, "currency", "_rate")
    return priced.withColumn("price_usd", to_base_for_load(F.col("price"), F.col("currency"), F.col("_rate"))).drop("_rate")


def price_options(beans: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per distinct option, with prices per kg. Beans without options have none."""
    rows = beans.select(F.col("id").alias("bean_id"), "currency", F.explode("price_options").alias("o")).select("bean_id", "currency", "o.weight", "o.price").distinct()
    priced = with_rate(rows, rates, "currency", "_rate")
    per = F.try_divide(F.col("price"), F.col("weight") / 1000.0)
    return priced.select("bean_id", "weight", "price", "currency", per.alias("price_per_kg"), to_base_for_load(per, F.col("currency"), F.col("_rate")).alias("price_per_kg_usd"))


def patched(beans: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches in order of time, those out of bounds left out as a whole. Prices in the
    base currency must be computed after this."""
    p = patches.withColumns({"_at": F.col("scraped_at").try_cast("timestamp"), "weight": F.col("weight").cast("int")})
    bounds = F.coalesce(F.col("price") <= 150, F.lit(True)) & F.coalesce(F.col("weight").between(50, 10_000), F.lit(True)) & F.coalesce(F.col("cupping_score").between(70, 100), F.lit(True))
    return apply_patches(beans, p, "url", "_at", PATCHED, "filename", bounds)


def corpus(beans: DataFrame, origins: DataFrame) -> DataFrame:
    """One row of text per bean, for search."""
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ").alias(c)
    o = origins.groupBy(F.col("bean_id").alias("id")).agg(*[texts(c) for c in ("country", "state_canonical", "producer", "farm", "process", "variety")])
    return beans.select("id", "name", "roaster", F.array_join("tasting_notes", " ").alias("notes")).join(o, "id", "left")
