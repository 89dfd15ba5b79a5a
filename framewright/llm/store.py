"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import save

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local session that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[sc.applicationId] = "file://" + folder
    return _own[sc.applicationId]


def remove(spark: SparkSession, path: str, later: bool = False) -> None:
    """Delete a folder of the shared store, now or when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at) if later else fs.delete(at, True)


#: A written table of ids and counts has a file for about so many rows.
FILE_ROWS = 25_000


def cut(df: DataFrame, rows: int | None = None, deal: bool = False, tables: list | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    With ``rows``, about how many there are, short tables get a few files rather
    than one for each shuffle partition: by fewer tasks, or with ``deal``, where
    the step before is dear, by dealing its results out anew.  The table goes
    when the application ends, if not before.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(1, -(-int(rows) // FILE_ROWS))
        df = df.repartition(files) if deal else df.coalesce(files)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    save(df, path, compression="zstd")
    remove(spark, path, later=True)
    if tables is not None:
        tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The written tables of one job; ``close`` deletes them."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame, rows: int | None = None, deal: bool = False) -> DataFrame:
        return cut(df, rows, deal, self.tables)

    def close(self) -> None:
        while self.tables:
            remove(*self.tables.pop())


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], spread, salts: int = 8) -> DataFrame:
    """Left join that deals each key's left rows over ``salts`` tasks.

    ``right`` has one row a key and is repeated once a salt; ``spread`` is a
    column of ``left`` that differs between the rows of a hot key.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")
