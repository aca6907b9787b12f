"""Tables of a SQLite file as a Spark data source.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", file).option("table", name).load()

A table is split by ranges of its row ids, each read by a task of its own with the filters
that SQLite can test. With a schema given, only its columns are read; ``rowid`` may be one
of them. The file must lie where all executors see it.
"""
from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

#: Rows read at a time.
BATCH = 4096
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _condition(f: Filter) -> tuple[str, list] | None:
    """What SQLite tests just as Spark would: values compare by type there, so only whole
    numbers and text are handed on."""
    if len(f.attribute) != 1:
        return None
    column = _named(f.attribute[0])
    if type(f) in _COMPARED and isinstance(f.value, (int, str)) and not isinstance(f.value, bool):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and f.value and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in f.value):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{column} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL", []
    return None


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            test = _condition(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[RowRange]:
        with _opened(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        where = " AND ".join(["rowid BETWEEN ? AND ?", *[t for t, _ in self.tests]])
        columns = ", ".join(_named(f.name) for f in self.schema) or "1"
        values = [partition.first, partition.last, *[v for _, own in self.tests for v in own]]
        shape = to_arrow_schema(self.schema)
        with _opened(self.path) as con:
            found = con.execute(f"SELECT {columns} FROM {_named(self.table)} WHERE {where}", values)
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), shape)], schema=shape)


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        """Declared types by SQLite's rules of affinity: INT is a long, CHAR, CLOB and TEXT
        are text, REAL, FLOA and DOUB are double, all else is text."""
        with _opened(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        out = StructType()
        for _, name, declared, *_ in columns:
            kind = declared.upper()
            out.add(name, "long" if "INT" in kind else "double" if any(x in kind for x in ("REAL", "FLOA", "DOUB")) and not any(x in kind for x in ("CHAR", "CLOB", "TEXT")) else "string")
        return out

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema else reader).load()


def decision(fields: Column) -> Column:
    """The value of the first entry whose key is ``decision``, in a JSON list of entries."""
    entries = F.from_json(fields, "array<struct<key:string,value:string>>")
    return F.get(F.filter(entries, lambda e: e["key"] == "decision"), F.lit(0))["value"]


def latest_decisions(feedback: DataFrame) -> DataFrame:
    """entity_url_path, decision, id: the newest open review of each product (kind
    product-review, status new, by row id); products whose newest has no decision are out."""
    open_ = feedback.where("kind = 'product-review' AND status = 'new'")
    last = open_.groupBy("entity_url_path").agg(F.max_by(F.struct("id", "fields"), "rowid").alias("r"))
    return last.select("entity_url_path", decision(F.col("r.fields")).alias("decision"), F.col("r.id").alias("id")).where("decision IS NOT NULL")
