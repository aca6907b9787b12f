"""Readers of a catalogue's files: product snapshots, patches, dimensions, mappings, logs.

Snapshots lie at ``<owner>/<yyyymmdd>/<slug>_<hhmmss>.json``, one object per file;
patches beside them as ``*.diffjson``. Schemas are explicit: unknown fields are dropped,
missing ones are null, and files that cannot be parsed give no row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions.text import bare_name
from shelfmark.shared import checkpoint

#: Read-time schemas (fixed field names of the file formats).
SNAPSHOT = (
    "name string, roaster string, url string, is_single_origin boolean, price_paid_for_green_coffee double, "
    "currency_of_price_paid_for_green_coffee string, roast_level string, roast_profile string, weight string, price string, "
    "currency string, is_decaf boolean, cupping_score double, is_tasting_kit boolean, requires_review boolean, "
    "tasting_notes array<string>, description string, in_stock boolean, scraped_at string, scraper_version string, image_url string, "
    "origins array<struct<country:string,region:string,producer:string,farm:string,elevation_min:string,elevation_max:string,"
    "latitude:string,longitude:string,process:string,variety:string,harvest_date:string>>, "
    "price_options array<struct<weight:int,price:double>>"
)
PATCH = (
    "url string, name string, roast_level string, roast_profile string, price_options array<struct<weight:int,price:double,currency:string>>, "
    "price double, weight int, currency string, is_decaf boolean, cupping_score double, description string, in_stock boolean, "
    "is_tasting_kit boolean, requires_review boolean, tasting_notes array<string>, scraped_at string, scraper_version string"
)
MEDIA = (
    "id string, podcast_name string, episode_title string, url string, segments array<struct<title:string,summary:string,"
    "timestamp_start:double,timestamp_end:double,key_takeaway:string,raw_text:string,"
    "entities:array<struct<entity_type:string,canonical_id:string,raw_name:string>>>>"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast, in order; those that lack are null."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    )


def with_path(df: DataFrame) -> DataFrame:
    """Adds filename, and owner and day from its last three parts."""
    path = F.col("_metadata.file_path")
    part = lambda i: F.split_part(path, F.lit("/"), F.lit(i))
    return df.select("*", path.alias("filename"), part(-3).alias("owner_dir"), part(-2).alias("scrape_date"))


def _json(spark: SparkSession, paths: str | list[str], schema: str, glob: str) -> DataFrame:
    if paths == []:
        return spark.createDataFrame([], StructType.fromDDL(f"{schema}, filename string, owner_dir string, scrape_date string"))
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    if isinstance(paths, str):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return with_path(reader.json(paths))


def snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All snapshots below a folder, or those of a list of files (an empty list: no rows)."""
    return _json(spark, paths, SNAPSHOT, "*.json")


def patches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _json(spark, paths, PATCH, "*.diffjson")


def patch_days(spark: SparkSession, folder: str) -> DataFrame:
    """owner_dir, scrape_date of the folders that hold patches."""
    return patches(spark, folder).select("owner_dir", "scrape_date").distinct()


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; columns go by position, codes stay text."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def mapping(spark: SparkSession, path: str, schema: str, key: str, order: str | None = None) -> DataFrame:
    """A JSON list of records; of records with one key the last in ``order`` stays."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    by = F.struct(*([order] if order else []), *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), by).alias("_m")).select(key, "_m.*")


def open_notes(spark: SparkSession, path: str, done: DataFrame, least: float = 0.7) -> DataFrame:
    """note: each distinct trimmed note of the confident rows of a category CSV (the note
    itself and its three categories), without those that ``done`` (note) has."""
    columns = ["tasting_note", "tertiary_category", "secondary_category", "primary_category"]
    rows = spark.read.option("header", True).csv(path).where(F.col("confidence").try_cast("double") > least)
    notes = rows.select(F.explode(F.array(*[F.btrim(c) for c in columns])).alias("note")).where("note <> ''").distinct()
    return notes.join(done, "note", "left_anti")


def registered(rows: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """``rows``, after a check that each value of ``column`` that is not null is in the
    dimension. Others raise, with up to ten of them named."""
    lost = rows.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct().join(dimension.select(F.col(key).alias("_v")), "_v", "left_anti")
    if names := [r[0] for r in lost.orderBy("_v").limit(10).collect()]:
        raise ValueError(f"{column} not in the dimension: {names}")
    return rows


def region_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """country, region, state: one JSON object per country, keyed by raw region; a region
    mapped to null is there with a null state."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    country = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    entries = F.from_json("value", "map<string,struct<canonical_state:string,confidence:double>>")
    return text.select(country.alias("country"), F.explode(entries).alias("region", "m")).select("country", "region", F.col("m.canonical_state").alias("state"))


def farm_mappings(spark: SparkSession, path: str) -> DataFrame:
    """country, region, alias, farm: one row per alias. Names as they were found are
    normalised here, those of the list of normalised names once more."""
    schema = "country string, region string, canonical_farm_name string, normalized_farm_names array<string>, original_farm_names array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("normalized_farm_names", none), F.coalesce("original_farm_names", none))
    named = rows.select("country", "region", F.explode(every).alias("raw"), F.col("canonical_farm_name").alias("farm"))
    return named.select("country", "region", bare_name(F.col("raw")).alias("alias"), "farm").where("alias <> ''").distinct()


def rates(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """currency, rate, fetched_at from a JSON object with a map of rates; the base has 1."""
    rows = spark.read.schema("base string, rates map<string,double>").option("multiLine", True).json(path)
    long = rows.select(F.explode("rates").alias("currency", "rate")).unionByName(rows.select(F.col("base").alias("currency"), F.lit(1.0).alias("rate")))
    return long.dropDuplicates(["currency"]).withColumn("fetched_at", F.lit(fetched_at).cast("timestamp_ntz"))


def media(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes; a missing id or show name comes from ``<show>/<id>_analysis.json``."""
    rows = with_path(spark.read.schema(MEDIA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder))
    stem = F.regexp_extract("filename", r"([^/]+?)(?:_analysis)?\.json$", 1)
    show = F.regexp_replace(F.split_part("filename", F.lit("/"), F.lit(-2)), "_", " ")
    return rows.withColumns({"id": F.coalesce("id", stem), "podcast_name": F.coalesce("podcast_name", show)})


def media_tables(episodes: DataFrame) -> dict[str, DataFrame]:
    """episodes, segments and entities, with ids from the places of nested elements."""
    seg = episodes.select("id", F.posexplode("segments").alias("i", "s"))
    seg = seg.select(F.concat_ws("_", "id", F.col("i").cast("string")).alias("segment_id"), F.col("id").alias("episode_id"), "s.*")
    ent = seg.select("segment_id", F.posexplode("entities").alias("j", "e"))
    ent = ent.select(F.concat_ws("_", "segment_id", F.col("j").cast("string")).alias("entity_id"), "segment_id", "e.*")
    return {"episodes": episodes.drop("segments"), "segments": seg.drop("entities"), "entities": ent}


def unprocessed(spark: SparkSession, folder: str, glob: str, ledger: DataFrame | None, by_content: bool = False) -> DataFrame:
    """file_path, checksum of files that the ledger (file_path, checksum) lacks; with
    ``by_content`` also those that changed. Contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    listed = files.select(F.col("_metadata.file_path").alias("file_path"), F.sha2("content", 256).alias("checksum"))
    if ledger is None:
        return listed
    return listed.join(ledger, ["file_path", "checksum"] if by_content else ["file_path"], "left_anti").select("file_path", "checksum")


def refreshed(spark: SparkSession, folder: str, raw: DataFrame | None = None, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows and ledger after a folder has changed: rows of files that are gone or
    changed leave, new and changed files are read, all other rows stay as they are. Without
    ``raw`` everything is read. The star schema follows from the rows by pure functions.
    The driver lists the files to read, as it does for any scan."""
    now = unprocessed(spark, folder, "*.json", None)
    if raw is None or ledger is None:
        return snapshots(spark, folder), now
    fresh = now.join(ledger, ["file_path", "checksum"], "left_anti")
    stale = ledger.join(now, ["file_path", "checksum"], "left_anti").select(F.col("file_path").alias("filename"))
    kept = raw.join(stale, "filename", "left_anti").select(*raw.columns)
    return kept.unionByName(snapshots(spark, [r.file_path for r in fresh.select("file_path").collect()]).select(*raw.columns)), now


def with_audio(episodes: DataFrame, audio: DataFrame, columns: list[str], kind: str, kinds: str = "media_type") -> DataFrame:
    """Audio columns (by id) merged into episodes of one kind; values that are there stay
    where the metadata has none, and other kinds keep theirs."""
    found = audio.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    joined = episodes.join(found, (F.col("id") == F.col("_id")) & (F.col(kinds) == kind), "left")
    put = lambda c: F.coalesce(f"_a_{c}", c).alias(c) if c in episodes.columns else F.col(f"_a_{c}").alias(c)
    rest = [c for c in episodes.columns if c not in columns]
    return joined.select(*rest, *[put(c) for c in columns])


def written_sorted(df: DataFrame, path: str, order: list[str], form: str = "json") -> None:
    """A small table, as a mapping is, as one file in a total order, so that equal tables
    give equal files. One task writes it; see ``written_in_parts`` for others."""
    df.orderBy(*order).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").format(form).option("header", True).option("ignoreNullFields", False).save(path)


def written_in_parts(df: DataFrame, path: str, order: list[str], rows: int = 10_000) -> None:
    """A table of any size as JSON lines in a total order, ``rows`` to a file, and a manifest
    (file, rows, first and last key, sha256 of the lines). Which rows a file holds hangs on
    their place in the order alone, so equal tables give equal files and digests, however
    many tasks have written them."""
    from shelfmark.operators.versions import surrogate_ids

    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    placed = surrogate_ids(df.select(*order, line.alias("_line")), [*order, "_line"], "_id")
    dealt = placed.withColumn("file", F.lpad(F.floor((F.col("_id") - 1) / rows).cast("string"), 10, "0"))
    dealt.repartition("file").sortWithinPartitions("file", "_id").select("_line", "file").write.mode("overwrite").partitionBy("file").text(f"{path}/data")
    key = F.to_json(F.struct(*order), {"ignoreNullFields": "false"})
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_id", "_line"))), lambda x: x["_line"])  # ``rows`` at most
    listed = dealt.groupBy("file").agg(F.count("*").alias("rows"), F.min_by(key, "_id").alias("first"), F.max_by(key, "_id").alias("last"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
    listed.orderBy("file").write.mode("overwrite").json(f"{path}/manifest")


def failed_days(spark: SparkSession, path: str) -> DataFrame:
    """owner, day, failed from logs whose header lines (``=== yyyy-mm-dd``) date the lines
    after them (``OK owner`` or ``FAIL owner``); a success on a day beats a failure. A log
    is read by as many tasks as its size asks for: a line's place is the block that it is
    read with, and its number there; days are carried over from block to block."""
    from shelfmark.operators.scans import last_seen

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = checkpoint(text)
    header = F.nullif(F.regexp_extract("value", r"^=== (\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    dated = last_seen(lines, ["f"], ["block", "n"], header, "day")
    outcome = dated.select("day", F.regexp_extract("value", r"^(OK|FAIL) (\S+)", 1).alias("o"), F.regexp_extract("value", r"^(OK|FAIL) (\S+)", 2).alias("owner"))
    return outcome.where("o <> '' AND day IS NOT NULL").groupBy("owner", "day").agg(F.bool_and(F.col("o") == "FAIL").alias("failed"))
