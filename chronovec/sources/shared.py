"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where none is set, a temporary one on a local master, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, so that what was computed or numbered stays as it is."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Deletes the tables that operators write inside the block when it ends; results must have been used or saved by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
