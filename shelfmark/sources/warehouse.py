"""A star schema that follows a folder of snapshot files, changed as a whole.

Tables lie in buckets of owners, as all that is derived from an owner's files is derived
from no other's. A refresh compares the files with a ledger, reads those that are new or
changed, and writes new versions of the buckets that a new, changed or missing file falls
into; all other buckets stay the files that they are. The manifest that names the versions
is written last, so that readers see all tables of before or all of after, and a refresh
that fails leaves the old ones. Beans keep their ids; new ones get the next.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.operators import etl
from shelfmark.operators.versions import surrogate_ids
from shelfmark.shared import checkpoint, removed
from shelfmark.sources import catalogue as C
from shelfmark.sources.manifest import Manifest

BUCKETS = 32
#: Tables that come from files, and those that follow from them.
SOURCES = ("ledger", "snapshots", "patches")
STAR = ("beans", "origins", "price_options", "corpus")


def _bucket(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


def files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """file_path, checksum, owner_dir, b of all snapshots and patches below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*json").load(folder)
    path = F.col("_metadata.file_path")
    owner = F.split_part(path, F.lit("/"), F.lit(-3))
    rows = found.select(path.alias("file_path"), F.sha2("content", 256).alias("checksum"), owner.alias("owner_dir"), _bucket(owner).alias("b"), *(["content"] if content else []))
    return rows.where(F.col("file_path").rlike(r"\.(json|diffjson)$"))


def _parsed(contents: DataFrame, schema: str, ending: str) -> DataFrame:
    """Rows of one-object files, as the reader of such files gives them: a text that is no
    object gives none."""
    own = contents.where(F.col("file_path").endswith(ending))
    o = F.from_json(F.col("content").cast("string"), f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = own.select("file_path", "owner_dir", "b", o.alias("o")).where("o IS NOT NULL AND o._corrupt_record IS NULL")
    day = F.split_part("file_path", F.lit("/"), F.lit(-2))
    return rows.select("o.*", F.col("file_path").alias("filename"), "owner_dir", day.alias("scrape_date"), "b").drop("_corrupt_record")


@dataclass
class Dimensions:
    """countries: name, code. regions: country, region, state. farms: country, region,
    alias, farm. rates: currency, rate, fetched_at. processes, varieties (or nothing):
    original_name, common_name."""

    countries: DataFrame
    regions: DataFrame
    farms: DataFrame
    rates: DataFrame
    processes: DataFrame | None = None
    varieties: DataFrame | None = None


class Warehouse:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = Manifest(spark, self.folder)

    def state(self) -> tuple[int, dict]:
        return self.manifest.newest()

    def table(self, name: str, buckets: list[int] | None = None, content: dict | None = None) -> DataFrame | None:
        """A table as the newest manifest (or ``content``) has it; nothing before the first
        refresh. Each version is read once, for the buckets that it still holds."""
        content = self.state()[1] if content is None else content
        if not content:
            return None
        entry = content["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        held: dict[str, list[int]] = {}
        for b, version in entry["buckets"].items():
            if buckets is None or int(b) in buckets:
                held.setdefault(version, []).append(int(b))
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{v}").where(F.col("b").isin(bs)) for v, bs in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame, version: str, touched: list[int], content: dict) -> dict:
        """``df`` as the new version of the touched buckets of a table; its new entry."""
        df.repartition("b").write.partitionBy("b").parquet(f"{self.folder}/{name}/{version}")
        before = content["tables"][name]["buckets"] if content else {}
        return {"schema": df.schema.jsonValue(), "buckets": before | {str(b): version for b in touched}}

    def _derived(self, beans: DataFrame, patches: DataFrame, dims: Dimensions) -> dict[str, DataFrame]:
        """The star schema of beans (numbered, with nested columns) and their patches."""
        own = beans.select(F.col("id").alias("bean_id"), "b")
        found = etl.origins(beans, dims.countries, dims.regions, dims.farms)
        for column, mapping in (("process", dims.processes), ("variety", dims.varieties)):
            name = f"{column}_common_name"
            found = found.withColumn(name, F.lit(None).cast("string")) if mapping is None else etl.with_mapped(found, column, mapping, name)
        patched = etl.with_base_price(etl.patched(beans, patches), dims.rates)
        options = etl.price_options(beans, dims.rates)
        text = etl.corpus(patched, found).join(own.withColumnRenamed("bean_id", "id"), "id")
        return {"beans": patched, "origins": found.join(own, "bean_id"), "price_options": options.join(own, "bean_id"), "corpus": text}

    def refresh(self, folder: str, dims: Dimensions) -> list[int]:
        """Brings all tables to what the folder holds now; the buckets that changed."""
        number, content = self.state()
        now = checkpoint(files(self.spark, folder))
        ledger = self.table("ledger", content=content)
        if ledger is None:
            touched, fresh = list(range(BUCKETS)), None
        else:
            same = ["file_path", "checksum"]
            fresh = now.join(ledger.select(*same), same, "left_anti")
            gone = ledger.join(now.select(*same), same, "left_anti")
            touched = sorted(r[0] for r in fresh.select("b").union(gone.select("b")).distinct().collect())  # BUCKETS at most
        if not touched:
            return []
        contents = files(self.spark, folder, content=True)
        if fresh is not None:
            contents = contents.where(F.col("b").isin(touched)).join(fresh.select("file_path"), "file_path", "left_semi")
        version = f"v{number + 1}-{uuid.uuid4().hex}"
        tables = {"ledger": self._write("ledger", now.where(F.col("b").isin(touched)), version, touched, content)}
        current = now.select(F.col("file_path").alias("filename"), "checksum")
        for name, schema, ending in (("snapshots", C.SNAPSHOT, ".json"), ("patches", C.PATCH, ".diffjson")):
            rows = _parsed(contents, schema, ending)
            if ledger is not None:
                unchanged = ledger.where(F.col("b").isin(touched)).select(F.col("file_path").alias("filename"), "checksum").join(current, ["filename", "checksum"], "left_semi")
                rows = self.table(name, touched, content).join(unchanged.select("filename"), "filename", "left_semi").select(*rows.columns).unionByName(rows)
            tables[name] = self._write(name, rows, version, touched, content)
        rows = {name: self.table(name, touched, {"tables": tables}) for name in ("snapshots", "patches")}
        days = rows["patches"].select("owner_dir", "scrape_date").distinct()
        beans = etl.bean_rows(rows["snapshots"].drop("b"), days).withColumn("b", _bucket(F.col("owner_dir")))
        last = content.get("last_id", 0)
        if content:
            known = self.table("beans", touched, content).select("owner_dir", "url", "id")
            beans = checkpoint(beans.join(known, ["owner_dir", "url"], "left"))
            new = surrogate_ids(beans.where("id IS NULL").drop("id"), ["name", "owner_dir", "url"], "id", after=last)
            beans = beans.where("id IS NOT NULL").unionByName(new)
        else:
            beans = surrogate_ids(beans, ["name", "owner_dir", "url"], "id")
        return self._put(number, content, tables, checkpoint(beans), rows["patches"], dims, version, touched, last)

    def recompute(self, dims: Dimensions) -> None:
        """The star schema anew from the stored rows, for other mappings or rates. No file is
        read again."""
        number, content = self.state()
        rows, everything = {n: self.table(n, content=content) for n in SOURCES}, list(range(BUCKETS))
        beans = etl.bean_rows(rows["snapshots"].drop("b"), rows["patches"].select("owner_dir", "scrape_date").distinct())
        known = self.table("beans", content=content).select("owner_dir", "url", "id", "b")
        beans = checkpoint(beans.join(known, ["owner_dir", "url"]))
        kept = {n: content["tables"][n] for n in SOURCES}
        self._put(number, content, kept, beans, rows["patches"], dims, f"v{number + 1}-{uuid.uuid4().hex}", everything, content["last_id"])

    def _put(self, number, content, tables, beans, patches, dims, version, touched, last) -> list[int]:
        for name, df in self._derived(beans, patches.drop("b"), dims).items():
            tables[name] = self._write(name, df, version, touched, content)
        newest = beans.agg(F.max("id")).first()[0] or 0
        self.manifest.put(number + 1, {"tables": tables, "last_id": max(last, newest)})
        return touched

    def vacuum(self) -> int:
        """Deletes versions that the newest manifest does not name; how many went."""
        entries, gone = self.state()[1]["tables"], 0
        for name, entry in entries.items():
            named = set(entry["buckets"].values())
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in store.listStatus(path):
                if status.getPath().getName() not in named:
                    gone += removed(self.spark, str(status.getPath()))
        return gone
