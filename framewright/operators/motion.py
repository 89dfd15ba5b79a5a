"""Best-match block search over recent reference frames.

Blocks may have any size of the adaptive partition.  Places to try are arrays of
offsets of a block and a reference; costs are computed where the block's pixels
meet the reference's tile (``tiles.offset_costs``), so only tiles are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import frame_index
from ..sources.shared import by_sort
from . import tiles as arrays
from .tiles import LEAF

PLACE = (*LEAF, "ref_f")
CANDIDATE = (*PLACE, "dx", "dy")
#: The largest block, and so the width of the strips that tiles get from their neighbours.
MOST = 32


def reference_pairs(frames: DataFrame, max_refs: int = 4, index: DataFrame | None = None) -> DataFrame:
    """(video_id, f, ref_f, ref): up to four earlier frames; ref counts list places from the oldest down from 4."""
    index = (frame_index(frames) if index is None else index).select("video_id", "f", "n")
    ages = index.withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(max_refs)))).withColumn("m", F.col("n") - F.col("age"))
    earlier = index.select("video_id", F.col("f").alias("ref_f"), F.col("n").alias("m"))
    ref = F.lit(4) - (F.col("m") - F.greatest(F.lit(0), F.col("n") - max_refs))
    return ages.join(by_sort(earlier), ["video_id", "m"]).select("video_id", "f", "ref_f", ref.cast("int").alias("ref"))


def candidates(blocks: DataFrame, refs: DataFrame, ends: DataFrame, lo: int = -2, hi: int = 1) -> DataFrame:
    """In-frame candidate places of every block (video_id, f, x, y, size), reference and offset."""
    rows = blocks.select(*LEAF).join(by_sort(refs.drop("ref")), ["video_id", "f"]).join(by_sort(ends), "video_id").select("*", F.inline_outer(arrays.window_offsets(lo, hi)))
    return rows.where(_inside()).select(*CANDIDATE)


def _inside() -> str:
    """A block that leaves the frame has only its pixels inside it to match."""
    return " AND ".join(f"{c} + d{c} >= 0 AND {c} + d{c} + least(size, {e} - {c}) <= {e}" for c, e in (("x", "w"), ("y", "h")))


def frame_ends(tiles: DataFrame, size: int = 32) -> DataFrame:
    """Width and height of each video's frames from its tiles."""
    wide = lambda c, first, step: F.max(F.expr(f"t{c} * {size} + size(filter(transform(sequence(0, {size - 1}), k -> ym[k * {step}]), p -> p IS NOT NULL))"))
    return tiles.groupBy("video_id").agg(wide("x", 0, 1).alias("w"), wide("y", 0, size).alias("h"))


def own_arrays(blocks: DataFrame, tiles: DataFrame, size: int = 32) -> DataFrame:
    """Blocks with their own pixels, taken from the tiles unless they have them (``tiles.changed_blocks``)."""
    return blocks if "yb" in blocks.columns else arrays.block_arrays(blocks, tiles, size)


def match_cost(blocks: DataFrame, refs: DataFrame, tiles: DataFrame, lo: int = -2, hi: int = 1, most: int = MOST, size: int = 32) -> DataFrame:
    """Cost of every in-frame place of a window around each block: (video_id, f, x, y, size, ref_f, dx, dy, cost)."""
    asked = own_arrays(blocks, tiles, size).join(by_sort(refs.drop("ref")), ["video_id", "f"]).withColumn("offsets", arrays.window_offsets(lo, hi))
    return arrays.offset_costs(asked, arrays.references(tiles, most, size), most, size)


def best_match(costs: DataFrame) -> DataFrame:
    """The cheapest candidate; ties go to the older reference, then smaller dy, then dx."""
    best = costs.groupBy(*LEAF).agg(F.min(F.struct("cost", "ref_f", "dy", "dx")).alias("m"))
    return best.select(*LEAF, "m.ref_f", "m.dx", "m.dy", "m.cost")


def top_k_matches(costs: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy(*LEAF).orderBy("cost", "ref_f", "dy", "dx")
    return costs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def as_vectors(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Best matches as vectors: place in the reference, span to the target, reference number, cost."""
    return found.join(by_sort(refs), ["video_id", "f", "ref_f"]).selectExpr(
        "video_id", "f", "ref_f", "ref", "x + dx AS pos_x", "y + dy AS pos_y", "-dx AS span_x", "-dy AS span_y", "size", "cost"
    )


def motion_search(blocks: DataFrame, tiles: DataFrame, lo: int = -2, hi: int = 1, max_refs: int = 4, most: int = MOST, size: int = 32) -> DataFrame:
    """Vectors of the cheapest places of a window around each block."""
    refs = reference_pairs(tiles, max_refs)
    return as_vectors(best_match(match_cost(blocks, refs, tiles, lo, hi, most, size)), refs)


# Hexagons of radius 4 and 2, neighbours at radius 1.
RINGS = {
    4: ((0, 0), (2, 3), (-2, 3), (-4, 0), (-2, -4), (2, -4), (4, 0)),
    2: ((0, 0), (1, 1), (-1, 1), (-2, 0), (-1, -2), (1, -2), (2, 0)),
    1: ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (-1, 1), (1, -1)),
}


def pattern_search(blocks: DataFrame, tiles: DataFrame, cut: Callable[[DataFrame], DataFrame], window: int = 48, max_refs: int = 4, most: int = MOST, size: int = 32, refs: DataFrame | None = None) -> DataFrame:
    """The cheapest place of each block and reference by a frontier of hexagons: (video_id, f, x, y, size, ref_f, dx, dy, cost).

    A row of the frontier is a block and a reference with its best place so
    far.  A round tries the ring around that place.  A strictly cheaper place
    becomes the new centre; else the radius is halved; the round of radius 1 is
    a row's last.  Rounds go on until no row is active; as a row's cost falls
    with every move, that is reached.  A reference frame meets the list of the
    blocks that ask it, so that no round needs a shuffle; ``cut`` writes the ends.
    """
    refs = reference_pairs(tiles, max_refs) if refs is None else refs
    asked = own_arrays(blocks, tiles, size).join(by_sort(refs.drop("ref")), ["video_id", "f"])
    asked = asked.select("video_id", "ref_f", F.struct("f", "x", "y", "size", "yb", "ub", "vb").alias("block"))
    return cut(arrays.walked(asked, arrays.whole_frames(tiles, size), RINGS, window, size).select(*CANDIDATE, "cost"))


def combined_search(blocks: DataFrame, tiles: DataFrame, cut: Callable[[DataFrame], DataFrame], window: int = 48, lo: int = -2, hi: int = 1, max_refs: int = 4, most: int = MOST, size: int = 32) -> DataFrame:
    """Vectors by the hexagon frontier, then by all places of a small window around the block; the cheaper one is taken."""
    refs = reference_pairs(tiles, max_refs)
    found = pattern_search(blocks, tiles, cut, window, max_refs, most, size).unionByName(match_cost(blocks, refs, tiles, lo, hi, most, size))
    return as_vectors(best_match(found), refs)


def targets(vectors: DataFrame) -> DataFrame:
    """Vectors with the place of their block."""
    return vectors.withColumns({"x": F.col("pos_x") + F.col("span_x"), "y": F.col("pos_y") + F.col("span_y")})


def uncoded_blocks(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    return blocks.select(*LEAF).join(by_sort(targets(vectors).select(*LEAF)), list(LEAF), "left_anti")
