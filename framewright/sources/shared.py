"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that has none gets a temporary folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-frames-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return "file://" + _local[sc.applicationId]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_folder(spark: SparkSession) -> str:
    """A new folder of the shared store; it goes when the application ends."""
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def by_sort(df: DataFrame) -> DataFrame:
    """One side of a join of two tables that both grow: sorted and merged, never broadcast.

    Spark takes the size of pixels for that of the few rows they are made of, and
    that of a written table for its compressed one, and would send them whole
    through the driver.
    """
    return df.hint("merge")


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many partitions as the fixtures' frames, so that a join with pixels by more keys doesn't shuffle the pixels."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Spark then deletes a query's shuffle files when it ends, not when the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, **options: str) -> None:
    """Write a table that is read again from there: its shuffles go at once, the session's setting stays as it was."""
    conf = df.sparkSession.conf
    given = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if given is None else conf.set(CLEANUP, given)


def cut(df: DataFrame) -> DataFrame:
    """Write a table and go on from it; it goes when the application ends."""
    spark = df.sparkSession
    path = own_folder(spark)
    save(df, path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
