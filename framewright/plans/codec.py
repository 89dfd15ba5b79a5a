"""Whole encode and decode plans over tables of many videos.

Frames become tiles once, which are written with their leaves.  Blocks are the
leaves of the adaptive partition, from 4 pixels to a whole tile.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import motion, rebuild, stats, tiles, transform
from ..sources.frames import frame_index
from ..sources.shared import by_sort, deal
from ..sources.shared import cut as write

#: Earlier frames that a frame may refer to.
KEPT = 4


def encode(
    pixels: DataFrame, lo: int = -2, hi: int = 1, window: int | None = None, root: int = 32, threshold: int = 45, block: int | None = None, cut: Callable[[DataFrame], DataFrame] = write
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open loop, all frames at once: (vectors, coded, frame_stats); ``coded`` are the vectors with their levels.

    Blocks are the leaves of the partition of ``root`` pixels, or with
    ``block`` all of one size.  With ``window`` a frontier of hexagons searches
    that far around a block before the small window lo..hi is tried.  Tiles,
    changed leaves and vectors are written once by ``cut``.
    """
    t = tiles.leafy_tiles(pixels, root, threshold, planes=False) if block is None else tiles.grid(tiles.frame_tiles(pixels, root), block, root)
    t = cut(t.select(*tiles.TILE, "leaves", "has", "rgb"))
    changed = cut(tiles.changed_blocks(t, size=root))
    most = root if block is None else block
    if window is None:
        vectors = motion.motion_search(changed, t, lo, hi, KEPT, most, root)
    else:
        vectors = motion.combined_search(changed, t, cut, window, lo, hi, KEPT, most, root)
    vectors = cut(vectors)
    coded = transform.code_blocks(transform.residual_blocks(vectors, t, most, root, changed))
    return vectors, coded, stats.frame_stats(vectors, motion.uncoded_blocks(changed, vectors))


def _numbered(df: DataFrame, index: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the gap-free number of their frame, in its order in each file, so that a step reads its own."""
    return cut(df.join(by_sort(index.select("video_id", "f", "n")), ["video_id", "f"]).sortWithinPartitions("n"))


def _step(before: DataFrame, now: DataFrame, blocks: DataFrame, root: int) -> DataFrame:
    """Tiles of a step's frames: those of the step before, of one frame a video, with the rebuilt blocks laid over them."""
    at = [F.expr(f"CAST({c} div {root} AS INT) AS t{c}") for c in "xy"]
    rows = blocks.select("video_id", *at, F.struct("x", "y", "size", "yb", "ub", "vb").alias("b"))
    lists = deal(rows, "video_id").groupBy("video_id", "tx", "ty").agg(F.collect_list("b").alias("bs"))
    base = deal(before.drop("f"), "video_id").join(by_sort(deal(now.select("video_id", "f"), "video_id")), "video_id")
    return tiles.laid(base.join(by_sort(lists), ["video_id", "tx", "ty"], "left"), root)


def decode(pixels: DataFrame, coded: DataFrame, cut: Callable[[DataFrame], DataFrame] = write, smooth: bool = False, root: int = 32) -> DataFrame:
    """Tiles (video_id, f, tx, ty, ym, um, vm) of all frames from start frames and coded blocks; ``pixels`` names the frames.

    A step rebuilds frame k of every video.  It reads the last four steps'
    tables only, so the work of a step doesn't grow with the length of a video.
    """
    index = cut(frame_index(coded.select("video_id", "f").unionByName(pixels.select("video_id", "f"))))
    coded = _numbered(coded, index, cut)
    first = pixels.join(index.where("n = 0").select("video_id", "f").hint("shuffle_hash"), ["video_id", "f"], "left_semi")  # a merge would sort all pixels
    out = [cut(tiles.frame_tiles(first, root).select(*tiles.TILE, "ym", "um", "vm"))]
    for n in range(1, (index.agg(F.max("n")).first()[0] or 0) + 1):
        now = index.where(F.col("n") == n)
        mine = coded.where(F.col("n") == n)
        made = _step(out[-1], now, rebuild.rebuilt_blocks(transform.decode_blocks(mine), reduce(DataFrame.unionByName, out[-KEPT:]), root, root), root)
        out.append(cut(rebuild.smoothed(made, mine, size=root) if smooth else made))
    return reduce(DataFrame.unionByName, out)


def encode_closed_loop(
    pixels: DataFrame, cut: Callable[[DataFrame], DataFrame] = write, smooth: bool = True, root: int = 32, threshold: int = 45, window: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frame-stepped encode against rebuilt references: (vectors, coded, frame_stats, rebuilt tiles).

    Source tiles are written once; a step reads its own frames and the last
    four steps' rebuilt tables.
    """
    index = cut(frame_index(pixels))
    source = _numbered(tiles.leafy_tiles(pixels, root, threshold), index, cut)
    pairs = _numbered(motion.reference_pairs(pixels, KEPT, index), index, cut)
    rebuilt = [cut(source.where("n = 0").select(*tiles.TILE, "ym", "um", "vm"))]
    found, kept, left = [], [], []
    for n in range(1, (index.agg(F.max("n")).first()[0] or 0) + 1):
        now, mine, refs = (t.where(F.col("n") == n) for t in (index, source, pairs))
        refs, store = refs.drop("n"), reduce(DataFrame.unionByName, rebuilt[-KEPT:])
        changed = cut(tiles.changed_blocks(mine, rebuilt[-1], now, root))
        costs = motion.match_cost(changed, refs, store, most=root, size=root)
        if window is not None:
            costs = costs.unionByName(motion.pattern_search(changed, store, cut, window, KEPT, root, root, refs))
        vectors = motion.as_vectors(motion.best_match(costs), refs)
        coded = cut(transform.code_blocks(transform.residual_blocks(vectors, store, root, root, changed, matches=True)))
        vectors = coded.select(*vectors.columns)
        made = _step(rebuilt[-1], now, transform.rebuilt_coded(coded), root)
        rebuilt.append(cut(rebuild.smoothed(made, vectors, size=root) if smooth else made))
        found.append(vectors)
        kept.append(coded.drop("yp", "up", "vp"))
        left.append(motion.uncoded_blocks(changed, vectors))
    if not found:
        raise ValueError("no video has a second frame")
    all_of = partial(reduce, DataFrame.unionByName)
    return all_of(found), all_of(kept), stats.frame_stats(all_of(found), all_of(left)), all_of(rebuilt)
