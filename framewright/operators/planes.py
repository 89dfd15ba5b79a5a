"""Luma and chroma planes in fixed point, and frames rebuilt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.shared import by_sort


def luma(pixels: DataFrame) -> DataFrame:
    return pixels.select("video_id", "f", "x", "y", fn.luma_milli(F.col("r"), F.col("g"), F.col("b")).alias("ym"))


def chroma(pixels: DataFrame) -> DataFrame:
    """2x2 cells with raster-order weights 1, 1, 2, 4 of eight, in thousandths."""
    u, v = fn.chroma_micro(F.col("r"), F.col("g"), F.col("b"))
    weight = F.expr("CASE WHEN y % 2 = 0 THEN 1 WHEN x % 2 = 0 THEN 2 ELSE 4 END")
    cells = pixels.groupBy("video_id", "f", F.expr("CAST(x div 2 AS INT) AS cx"), F.expr("CAST(y div 2 AS INT) AS cy"))
    return cells.agg(F.floor(F.sum(u * weight) / 8000).alias("um"), F.floor(F.sum(v * weight) / 8000).alias("vm"))


def with_chroma(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Each pixel with its cell's chroma."""
    keyed = luma.withColumns({"cx": F.expr("CAST(x div 2 AS INT)"), "cy": F.expr("CAST(y div 2 AS INT)")})
    return keyed.join(by_sort(chroma), ["video_id", "f", "cx", "cy"])


def to_rgb(planes: DataFrame) -> DataFrame:
    """(video_id, f, x, y, r, g, b) from thousandths."""
    y, u, v = (F.col(c) / 1000.0 for c in ("ym", "um", "vm"))
    r, g, b = fn.yuv_to_rgb(y, u, v)
    return planes.select("video_id", "f", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


def assemble_raster(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Packed colours of every frame, row by row."""
    rgb = to_rgb(with_chroma(luma, chroma))
    code = fn.pack_argb(F.col("r"), F.col("g"), F.col("b"))
    rows = rgb.groupBy("video_id", "f").agg(F.array_sort(F.collect_list(F.struct("y", "x", code.alias("c")))).alias("px"))
    return rows.select("video_id", "f", F.col("px.c").alias("argb"))
