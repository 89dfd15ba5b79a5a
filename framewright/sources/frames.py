"""Frame sources and sinks: image folders, catalogues, gaps, start frames, tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_sort


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of ``video_id=*/NNNN.bmp`` folders: video_id, frame_no, width, height, n_channels, data (BGR rows)."""
    found = spark.read.format("image").load(path)
    return found.select(
        F.col("video_id").cast("long"),
        F.regexp_extract("image.origin", r"(\d+)\.\w+$", 1).cast("int").alias("frame_no"),
        "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data",
    )


def explode_pixels(frames: DataFrame) -> DataFrame:
    """One row per pixel of image buffers with 1 (grey), 3 (BGR) or 4 (BGRA) bytes a pixel; alpha is left out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for video, frame, w, h, c, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                flat = np.frombuffer(data, np.uint8).reshape(h * w, c)[:, [0, 0, 0] if c == 1 else [0, 1, 2]].astype(np.int32)
                n = np.arange(h * w, dtype=np.int32)
                cols = [np.full(h * w, video, np.int64), np.full(h * w, frame, np.int32), n % w, n // w, flat[:, 2], flat[:, 1], flat[:, 0]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["video_id", "f", "x", "y", "r", "g", "b"])

    cols = ["video_id", "frame_no", "width", "height", "n_channels", "data"]
    return frames.select(*cols).mapInArrow(run, "video_id long, f int, x int, y int, r int, g int, b int")


def explode_packed(frames: DataFrame) -> DataFrame:
    """One row per pixel of frames given as arrays of packed colours: (video_id, f, width, argb array)."""
    from ..functions.scalars import unpack_rgb

    rows = frames.select("video_id", "f", "width", F.posexplode("argb").alias("i", "c"))
    return rows.select("video_id", "f", F.expr("CAST(i % width AS INT) AS x"), F.expr("CAST(i div width AS INT) AS y"), *unpack_rgb(F.col("c")))


def frame_gaps(frames: DataFrame) -> DataFrame:
    """Missing numbers between each video's first and last frame."""
    ends = frames.groupBy("video_id").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    every = ends.select("video_id", F.explode(F.sequence("lo", "hi")).alias("f"))
    return every.join(by_sort(frames.select("video_id", "f").distinct()), ["video_id", "f"], "left_anti")


def video_catalog(pixels: DataFrame) -> DataFrame:
    """Width, height and number of frames after the first."""
    return pixels.groupBy("video_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.countDistinct("f") - 1).alias("n_delta_frames")
    )


def frame_index(frames: DataFrame) -> DataFrame:
    """Gap-free frame numbers from 0 and the predecessor."""
    w = Window.partitionBy("video_id").orderBy("f")
    once = frames.select("video_id", "f").distinct()
    return once.select("video_id", "f", (F.row_number().over(w) - 1).alias("n"), F.lag("f").over(w).alias("prev_f"))


def start_frame(pixels: DataFrame) -> DataFrame:
    """The first frame's colours as hex, column by column."""
    first = pixels.groupBy("video_id").agg(F.min("f").alias("f"))
    rows = pixels.join(by_sort(first), ["video_id", "f"])
    code = F.format_string("%02X%02X%02X", "r", "g", "b")
    ordered = F.array_sort(F.collect_list(F.struct("x", "y", code.alias("c"))))
    return rows.groupBy("video_id", "f").agg(ordered.alias("px")).select("video_id", "f", F.array_join("px.c", "").alias("rgb_hex"))


def resize_to_multiple(pixels: DataFrame, multiple: int = 4) -> DataFrame:
    """Bilinear shrink to the next lower multiple: pixel centres, weights in 1/1024 steps, whole numbers."""
    size = pixels.groupBy("video_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.selectExpr("*", f"w - w % {multiple} AS nw", f"h - h % {multiple} AS nh").where("nw > 0 AND nh > 0")
    sized = pixels.select("video_id", "f").distinct().join(by_sort(size), "video_id")
    rows = pixels.join(by_sort(sized), ["video_id", "f"])
    for c, n, full in (("x", "nw", "w"), ("y", "nh", "h")):
        # targets whose centre, in 1/1024 of a source pixel, lies next to this pixel, of the four that may; a pixel on the border may be both neighbours
        rows = rows.withColumn(f"t{c}", F.explode(F.expr("array(0, 1, 2, 3)"))).withColumn(f"t{c}", F.expr(f"CAST(((2L * {c} - 1) * {n} + 3 * {full}) div (2 * {full}) - 2 + t{c} AS INT)")).where(f"t{c} BETWEEN 0 AND {n} - 1")
        rows = rows.withColumn("s", F.expr(f"greatest(0L, least((CAST(2 * t{c} + 1 AS BIGINT) * {full} * 512) div {n} - 512, ({full} - 1) * 1024L))"))
        lo, hi = f"s div 1024 = {c}", f"least(s div 1024 + 1, {full} - 1) = {c}"
        rows = rows.where(f"{lo} OR {hi}").withColumn(f"w{c}", F.expr(f"CASE WHEN {lo} THEN 1024 - s % 1024 ELSE 0 END + CASE WHEN {hi} THEN s % 1024 ELSE 0 END")).drop("s")
    out = rows.withColumn("weight", F.expr("wx * wy")).groupBy("video_id", "f", "tx", "ty")
    return out.agg(*[F.expr(f"CAST((sum(weight * {c}) + 524288) div 1048576 AS INT) AS {c}") for c in "rgb"]).withColumnsRenamed({"tx": "x", "ty": "y"})


def write_table(df: DataFrame, path: str, whole: bool = True) -> None:
    """One folder per video; without ``whole`` only the folders of the videos in ``df`` are replaced.

    Rows of a video are dealt to one writing task by AQE's sizes, so that a big
    table has few files a video and a big video several.
    """
    dealt = df.hint("rebalance", "video_id")
    dealt.write.partitionBy("video_id").option("partitionOverwriteMode", "static" if whole else "dynamic").mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The written table; a filter on ``video_id`` reads those folders only."""
    df = spark.read.parquet(path)
    return df.withColumn("video_id", F.col("video_id").cast("long"))
