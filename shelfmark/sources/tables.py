"""Parquet tables of one folder."""
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; column pruning and filters reach the scan as usual."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
