"""Records of several shapes in one column, brought to the newest by one projection.

Shape 0 has one ``origin`` object, with process, variety and harvest date beside it; shape
1 has ``origins`` with one ``elevation`` each; shape 2 has ``elevation_min`` and
``elevation_max``. A record is a VARIANT, so shapes and mixtures of them stand side by side
and each field is taken from wherever its shape has it. Records of shape 2 stay as they
are, so a second migration changes nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roast levels, and what stands for others.
LEVELS = ("Light", "Medium-Light", "Medium", "Medium-Dark", "Dark")
OTHER_LEVELS = {"Filter": "Medium", "Espresso": "Medium", "Omni": "Medium"}
#: Fields that no shape moves, with their types and defaults.
KEPT = {
    "name": ("string", None), "roaster": ("string", None), "url": ("string", None), "image_url": ("string", None), "is_single_origin": ("boolean", True), "price_paid_for_green_coffee": ("double", None),
    "currency_of_price_paid_for_green_coffee": ("string", None), "roast_profile": ("string", None), "weight": ("int", None), "price": ("double", None), "currency": ("string", "GBP"), "is_decaf": ("boolean", False),
    "cupping_score": ("double", None), "description": ("string", None), "in_stock": ("boolean", None), "scraped_at": ("string", None), "scraper_version": ("string", "1.0"),
}
PLACE = ("country", "region", "producer", "farm")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _there(v: Column, path: str) -> Column:
    """Whether a field is there at all, null or not."""
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def roast_level(text: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in OTHER_LEVELS.items() for x in pair])
    return F.when(text.isin(*LEVELS), text).otherwise(F.try_element_at(mapped, text))


def harvest_date(text: Column, now: Column) -> Column:
    """As ISO 8601; nothing if it is no date, before 2020 or after now."""
    at = text.try_cast("timestamp_ntz")
    return F.when((at >= F.lit("2020-01-01").cast("timestamp_ntz")) & (at <= now), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def _origin(o: Column, process: Column, variety: Column, harvest: Column) -> Column:
    """An origin object of any shape. One elevation stands for both ends, none or less for 0."""
    old = F.greatest(F.coalesce(_get(o, "elevation", "double"), F.lit(0.0)), F.lit(0.0))
    split = _there(o, "elevation_min") | _there(o, "elevation_max")
    end = lambda c: F.when(split, _get(o, c, "double")).otherwise(old).cast("int")
    return F.struct(
        *[_get(o, c, "string").alias(c) for c in PLACE],
        end("elevation_min").alias("elevation_min"),
        end("elevation_max").alias("elevation_max"),
        *[_get(o, c, "double").alias(c) for c in ("latitude", "longitude")],
        F.coalesce(_get(o, "process", "string"), process).alias("process"),
        F.coalesce(_get(o, "variety", "string"), variety).alias("variety"),
        F.coalesce(_get(o, "harvest_date", "string"), harvest).alias("harvest_date"),
    )


def migrated(df: DataFrame, record: str, now: Column | None = None) -> DataFrame:
    """df with ``shape`` (0, 1 or 2) and ``bean``, a struct of the newest shape, from a
    column of JSON text or VARIANT. Text that is no JSON object gives null for both."""
    v = F.col(record) if df.schema[record].dataType.typeName() == "variant" else F.try_parse_json(F.col(record))
    rows = df.withColumn("_v", v)
    v, now = F.col("_v"), F.localtimestamp() if now is None else now
    many = F.try_variant_get(v, "$.origins", "array<variant>")
    none = F.lit(None).cast("string")
    moved = [_get(v, "process", "string"), _get(v, "variety", "string"), harvest_date(_get(v, "harvest_date", "string"), now)]
    one = F.array(_origin(F.coalesce(F.try_variant_get(v, "$.origin", "variant"), F.parse_json(F.lit("{}"))), *moved))
    origins = F.when(many.isNotNull(), F.transform(many, lambda o: _origin(o, none, none, none))).otherwise(one)
    halves = F.exists(F.coalesce(many, F.array().cast("array<variant>")), lambda o: _there(o, "elevation") & ~_there(o, "elevation_min") & ~_there(o, "elevation_max"))
    kept = [(F.coalesce(_get(v, c, kind), F.lit(default)) if default is not None else _get(v, c, kind)).alias(c) for c, (kind, default) in KEPT.items()]
    notes = F.coalesce(F.try_variant_get(v, "$.tasting_notes", "array<string>"), F.array().cast("array<string>"))
    bean = F.struct(*kept, roast_level(_get(v, "roast_level", "string")).alias("roast_level"), notes.alias("tasting_notes"), origins.alias("origins"))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    shape = F.when(many.isNull(), 0).when(halves, 1).otherwise(2)
    return rows.withColumns({"shape": F.when(is_object, shape), "bean": F.when(is_object, bean)}).drop("_v")
