"""Block aggregates: means, spread, adaptive partitioning, change detection, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import frame_index
from ..sources.shared import by_sort
from . import tiles

CELL = ("video_id", "f")


def cell_means(pixels: DataFrame) -> DataFrame:
    """Truncated mean colour of every 4x4 cell."""
    keys = [F.expr(f"CAST({c} div 4 AS INT) AS c{c}") for c in "xy"]
    return pixels.groupBy(*CELL, *keys).agg(*[F.expr(f"CAST(sum({c}) div 16 AS INT) AS {c}") for c in "rgb"])


def block_means(cells: DataFrame, size: int) -> DataFrame:
    """Rounded mean of the cell means of every block."""
    n = size // 4
    keys = [F.expr(f"CAST(c{c} div {n} AS INT) AS b{c}") for c in "xy"]
    return cells.groupBy(*CELL, *keys).agg(*[F.expr(f"CAST(floor(CAST(sum({c}) AS DOUBLE) / count(*) + 0.5) AS INT) AS {c}") for c in "rgb"]).withColumn("size", F.lit(size))


def block_variance(pixels: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """Summed squared distance from the block's mean: (…, bx, by, size, dev2, n), whole numbers."""
    keys = [F.expr(f"CAST({c} div {size} AS INT) AS b{c}") for c in "xy"]
    sums = pixels.groupBy(*CELL, *keys).agg(*[F.expr(f"sum({c}) AS s{c}") for c in "rgb"], *[F.expr(f"sum({c} * {c}) AS q{c}") for c in "rgb"], F.count("*").alias("n"))
    joined = sums.join(by_sort(block_means(cells, size)), [*CELL, "bx", "by"])
    dev2 = sum((F.expr(f"q{c} - 2 * {c} * s{c} + n * {c} * {c}") for c in "gb"), F.expr("qr - 2 * r * sr + n * r * r"))
    return joined.select(*CELL, "bx", "by", "size", dev2.alias("dev2"), "n", "r", "g", "b")


def block_stddev(pixels: DataFrame, size: int) -> DataFrame:
    """Square root of the mean squared distance, colours summed."""
    found = block_variance(pixels, cell_means(pixels), size)
    return found.select(*CELL, "bx", "by", F.round(F.sqrt(F.col("dev2") / F.col("n")), 6).alias("stddev"))


def quadtree(pixels: DataFrame, root: int = 32, threshold: int = 45, least: int = 4) -> DataFrame:
    """Leaves (video_id, f, x, y, size, r, g, b) of the adaptive partition.

    A tile is a root: sums of its cells are added up level by level inside the
    row, and a cell's leaf is its first ancestor from the top that isn't split.
    """
    return tiles.leaf_rows(pixels, root, threshold, least)


def mosaic(pixels: DataFrame, root: int = 32, threshold: int = 45, least: int = 4) -> DataFrame:
    """Every pixel with its leaf's mean colour."""
    return tiles.leaf_pixels(tiles.leafy_tiles(pixels, root, threshold, least), root)


def frame_delta(luma: DataFrame) -> DataFrame:
    """Luma minus the same pixel of the previous frame."""
    index = frame_index(luma).where("prev_f IS NOT NULL").select("video_id", "f", "prev_f")
    before = F.lag(F.struct("f", "ym")).over(Window.partitionBy("video_id", "x", "y").orderBy("f"))
    both = luma.join(by_sort(index), [*CELL], "left").withColumn("before", before)
    return both.where("before.f = prev_f").select(*CELL, "x", "y", (F.col("ym") - F.col("before.ym")).alias("d"))


def tile_blocks(luma: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Block cut-outs in column order; places outside the frame are 0 and counted."""
    keys = [F.expr(f"CAST({c} div {size} AS INT) AS b{c}") for c in "xy"]
    got = luma.groupBy(*CELL, *keys).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"CAST((x % {size}) * {size} + y % {size} AS INT)"), "ym"))).alias("m"), F.count("*").alias("n"))
    plane = F.expr(f"transform(sequence(0, {size * size - 1}), i -> coalesce(m[i], 0L))")
    return got.select(*CELL, "bx", "by", plane.alias("plane"), (size * size - F.col("n")).cast("int").alias("oob_count"))


def split_subtiles(samples: DataFrame, size: int) -> DataFrame:
    """Sub-tile number (columns first) and place inside it."""
    n = 8 // size
    return samples.selectExpr("tile", f"CAST((x div {size}) * {n} + y div {size} AS INT) AS sub", f"x % {size} AS x", f"y % {size} AS y", "val")


def merge_subtiles(subtiles: DataFrame, size: int) -> DataFrame:
    n = 8 // size
    return subtiles.selectExpr("tile", f"CAST((sub div {n}) * {size} + x AS INT) AS x", f"CAST((sub % {n}) * {size} + y AS INT) AS y", "val")
