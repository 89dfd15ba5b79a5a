"""A sink whose batches appear whole and once.

Each attempt at a batch writes a folder of its own under ``data``; a manifest
file named after the batch, put in place by a rename, then says which folder
counts.  Readers take the manifests' folders only, so what a stopped or repeated
attempt wrote is never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest(path: str, batch_id: int) -> str:
    return f"{path}/commits/{batch_id:012d}"


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    fs, at = _files(spark, _manifest(path, batch_id))
    return fs.exists(at)


def commit(spark: SparkSession, path: str, batch_id: int, folder: str) -> None:
    """Name ``folder`` as the batch's; the manifest appears whole."""
    fs, target = _files(spark, _manifest(path, batch_id))
    _, draft = _files(spark, f"{path}/drafts/{folder}")
    out = fs.create(draft, True)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(target.getParent())
    if not fs.rename(draft, target):
        raise RuntimeError(f"batch {batch_id} could not be committed")


def stream_sink(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every batch once, commit it by its number, and end with the input.

    A batch that is repeated after its commit is left alone; one repeated before
    is written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, path, batch_id):
            return
        folder = f"{batch_id:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{path}/data/{folder}")
        commit(spark, path, batch_id, folder)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches; without any, an empty table."""
    fs, at = _files(spark, f"{path}/commits")
    if not fs.exists(at) or not fs.listStatus(at):
        return spark.createDataFrame([], schema)
    folders = [r.value for r in spark.read.text(f"{path}/commits").collect()]  # one short line a batch
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders])


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete folders that no manifest names, and say how many; not to be run while a sink writes."""
    fs, at = _files(spark, f"{path}/commits")
    kept = {r.value for r in spark.read.text(f"{path}/commits").collect()} if fs.exists(at) and fs.listStatus(at) else set()
    fs, at = _files(spark, f"{path}/data")
    gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in kept]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
