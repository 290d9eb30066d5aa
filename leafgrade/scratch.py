"""Folders that driver and executors share, and tables that are made once in a session and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Where that is unset, a session in one process (local mode, as in tests) gets a temporary folder; on a
    cluster it is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='leafgrade-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in a fresh folder: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_derived: dict[tuple, DataFrame] = {}


def derived(spark: SparkSession, inputs: list[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, stored once for the session and the present state of the input paths."""
    state = []
    for path in inputs:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        state.append((path, status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, name, *state)
    if key not in _derived:
        _derived[key] = stored(make(), name)
    return _derived[key]
