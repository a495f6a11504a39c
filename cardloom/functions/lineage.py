"""Plans cut between the steps of a chain, by tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written tables of narrow rows up to so many are sent to every task.
SENT_ROWS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return str(context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The table as written to ``spark.checkpoint.dir``; only a session on one machine may go without that setting.

    It is written as Parquet, a fraction of the size of checkpointed rows, of which a reader takes the columns it needs.
    Shuffle files go when it is written, the table when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """As :func:`cut`, for a table of narrow rows; marked for broadcast if there are at most ``rows`` of them."""
    out = cut(df)
    return F.broadcast(out) if out.count() <= rows else out
