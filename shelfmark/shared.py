"""The folder that driver and executors share: checkpoints, state and files of operators."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders of this process that a scope around it may delete.
_MADE: list[str] = []


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where nobody has set it, a local session (as in
    tests) gets a temporary folder; on a cluster no folder of one machine would do."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return spark.conf.get("spark.checkpoint.dir", None) or base


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of whatever store Spark can write to; whether it was there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders and checkpoints that were made within. Write the
    result first: a frame that still reads them cannot be computed any more."""
    _base(spark)
    held, _MADE[:] = list(_MADE), []
    try:
        yield
    finally:
        for path in _MADE:
            removed(spark, path)
        _MADE[:] = held


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that a lost executor costs no rerun of what came before."""
    _base(df.sparkSession)
    kept = df.checkpoint()
    place = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if place.isDefined():
        _MADE.append(place.get())
    return kept
