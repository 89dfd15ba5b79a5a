"""Frame and tile tables derived from the driver's tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, f, x, y, r, g, b): six 32x32 frames a video with a moving square.

    The table they come from is one small file, so frames are dealt to partitions
    before their pixels are made: many tasks make them, and what groups pixels
    by frame or by more needs no other shuffle.
    """
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    base = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("video_id"))
    base = base.select("video_id", axis(5).alias("f")).where("NOT (f = 5 AND video_id % 10 = 7)")
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id", "f")
    base = base.select("*", axis(31).alias("x")).select("*", axis(31).alias("y"))
    base = base.selectExpr("*", "4 + (video_id % 4) * f AS ox", "4 + (video_id % 3) * f AS oy")
    inside = "x >= ox AND x < ox + 8 AND y >= oy AND y < oy + 8"
    return base.selectExpr(
        "video_id", "f", "x", "y",
        f"CAST(CASE WHEN {inside} THEN (x - ox) * 17 + (y - oy) * 11 + 40 ELSE (x * 2 + y * 3 + video_id * 11) % 200 END AS INT) AS r",
        f"CAST(CASE WHEN {inside} THEN 220 - (x - ox) * 9 ELSE (x + y * 2 + video_id * 7) % 180 END AS INT) AS g",
        f"CAST(CASE WHEN {inside} THEN (y - oy) * 25 + 30 ELSE (x * 3 + y + video_id * 5) % 220 END AS INT) AS b",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, x, y, val): every embedding as an 8x8 tile."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.selectExpr("vec_id AS tile", "CAST(i div 8 AS INT) AS x", "CAST(i % 8 AS INT) AS y", "floor(CAST(e AS DOUBLE) * 256) AS val")
