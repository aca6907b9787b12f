"""What a store holds, as numbered lists of which the newest counts.

Data is written first, under names that no list has yet, and its list last, in one file
that a rename puts in place. Whoever fails before that leaves the old state as it was.
"""
from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Parquet at a path, or nothing if nobody has written there yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class Manifest:
    """Numbered JSON objects below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/manifest"

    def newest(self) -> tuple[int, dict]:
        """Number and content of the newest, -1 and nothing before the first."""
        try:
            every = self.spark.read.schema("value string, v int").text(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        last = every.agg(F.max_by("value", "v"), F.max("v")).first()
        return (-1, {}) if last[1] is None else (last[1], json.loads(last[0]))

    def put(self, number: int, content: dict) -> None:
        """Fails if the number is there, as when another writer was faster."""
        self.spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.path}/v={number}")
