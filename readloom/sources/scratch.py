"""Tables between the steps of a query, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir. Where the setting is missing, a temporary folder takes its place, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/readloom-{uuid.uuid4().hex}"


#: Setting by which Spark removes what a query shuffled as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """df, written to scratch_path() and read back: what follows reads it as often as it likes, and a lost executor costs its tasks alone. Of a function that
    makes df, what it shuffled is removed once it is written."""
    if isinstance(df, DataFrame):
        return _written(df)
    spark = SparkSession.active()
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return _written(df())
    finally:
        spark.conf.set(CLEANUP, before)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by stored(), once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
