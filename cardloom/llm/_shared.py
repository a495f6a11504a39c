"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of any executor.  The folder is ``spark.checkpoint.dir``; where a
session on one machine names none (tests) a temporary folder of this process is set.  On a cluster the setting is needed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path there, deleted when the session's JVM ends unless it is to last."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        hadoop, store = _hadoop(spark, path)
        store.deleteOnExit(hadoop)
    return path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files when they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes not to meet one of the table's columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a table there and returns it as read from there."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that :func:`save` returned and that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            hadoop, store = _hadoop(table.sparkSession, path)
            store.delete(hadoop, True)
