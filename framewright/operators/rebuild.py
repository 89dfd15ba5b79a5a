"""Frames rebuilt from a base frame, vectors and residuals; edge smoothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..sources.shared import by_sort, deal
from . import tiles, transform
from .motion import targets
from .tiles import LEAF

PIXEL = ("video_id", "f", "x", "y")


def overlay(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Base pixels, overwritten where the patch has one."""
    new = patch.select(*PIXEL, F.col("ym").alias("new"))
    return base.join(by_sort(deal(new, "video_id", "f")), list(PIXEL), "left").select(*PIXEL, F.coalesce("new", "ym").alias("ym"))


def patch_union(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pixels of two patches; where both have one the vectors' wins."""
    both = blocks.withColumn("rank", F.lit(0)).unionByName(vectors.withColumn("rank", F.lit(1)))
    return both.groupBy(*PIXEL).agg(F.max(F.struct("rank", "ym")).alias("m")).select(*PIXEL, "m.ym")


def reconstruct(blocks: DataFrame) -> DataFrame:
    """(video_id, f, chan, x, y, value): pixels and chroma cells of rebuilt blocks (LEAF, yb, ub, vb), in thousandths."""
    rows = transform._long(blocks, LEAF, {"Y": "yb", "U": "ub", "V": "vb"}).where("a IS NOT NULL")
    n = "CASE WHEN chan = 'Y' THEN 1 ELSE 2 END"
    return rows.selectExpr("video_id", "f", "chan", f"CAST(x div {n} + i % (size div {n}) AS INT) AS x", f"CAST(y div {n} + i div (size div {n}) AS INT) AS y", "CAST(a AS BIGINT) AS value")


def rebuilt_blocks(residual: DataFrame, store: DataFrame, most: int = 32, size: int = 32) -> DataFrame:
    """Blocks (LEAF, yb, ub, vb): the matched pixels of earlier rebuilt frames plus the differences."""
    found = tiles.matched(targets(residual), tiles.references(store, most, size), most, size, _plus, "yb array<int>, ub array<int>, vb array<int>")
    return found.select(*LEAF, "yb", "ub", "vb")


def _plus(block: dict, match: list, size: int) -> list:
    d = [tiles.squares(block[name], (size // n) ** 2) for name, n in (("dy", 1), ("du", 2), ("dv", 2))]
    return [tiles._listed(m + k, m != tiles.GONE) for m, k in zip(match, d, strict=True)]


def reconstruct_step(t: DataFrame, blocks: DataFrame, index: DataFrame, size: int = 32) -> DataFrame:
    """One step of decoding for all frames at once: luma pixels of the frame before, a packed tile at a time, with this frame's blocks laid over them."""
    index = index.where("prev_f IS NOT NULL").select("video_id", "f", "prev_f")
    at = [F.expr(f"CAST({c} div {size} AS INT) AS t{c}") for c in "xy"]
    keys = ["video_id", "prev_f", "tx", "ty"]
    lists = blocks.join(by_sort(index), ["video_id", "f"]).select("video_id", "prev_f", *at, F.struct("x", "y", "size", "yb").alias("b"))
    lists = deal(lists, "video_id", "prev_f").groupBy(*keys).agg(F.collect_list("b").alias("bs"))
    base = deal(t.select("video_id", F.col("f").alias("prev_f"), "tx", "ty", "has", "rgb"), "video_id", "prev_f")
    both = base.join(by_sort(deal(index, "video_id", "prev_f")), ["video_id", "prev_f"]).join(by_sort(lists), keys, "left").select("video_id", "f", "tx", "ty", "has", "rgb", "bs")
    kinds = ", ".join(f"{c} {k}" for c, k in both.select(*tiles.TILE).dtypes)
    return tiles.luma_rows(both.mapInArrow(partial(_laid_luma, size=size), f"{kinds}, ym array<int>"), size)


def _laid_luma(batches: Iterator, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, tiles.SOME):
            part = batch.slice(start, tiles.SOME)
            luma, bs = tiles.packed_luma(part.column(4), part.column(5), size), part.column(6)
            t = np.repeat(np.arange(part.num_rows), bs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            tiles.paint([luma], [part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], t, bs.flatten(), size)
            flat = luma.reshape(len(luma), -1)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], tiles._listed(flat, flat != tiles.GONE)], [*tiles.TILE, "ym"])


def edges(vectors: DataFrame, vertical: bool) -> DataFrame:
    """Edge places of coded blocks: one row per line of a block that touches neither border."""
    b = vectors.selectExpr("video_id", "f", "pos_x + span_x AS bx", "pos_y + span_y AS by", "size").where("bx > 0 AND by > 0").distinct()
    line = b.withColumn("o", F.explode(F.expr("sequence(0, size - 1)")))
    return line.selectExpr("video_id", "f", *(("bx + o AS ex", "by AS ey") if vertical else ("bx AS ex", "by + o AS ey"))).distinct()


def edge_neighbours(luma: DataFrame, vectors: DataFrame, vertical: bool) -> DataFrame:
    """p2, p1, p0, q0, q1, q2 across every edge place."""
    step = F.explode(F.sequence(F.lit(-3), F.lit(2))).alias("s")
    at = edges(vectors, vertical).select("*", step)
    at = at.selectExpr("*", *(("ex AS x", "ey + s AS y") if vertical else ("ex + s AS x", "ey AS y")))
    names = {-3: "p2", -2: "p1", -1: "p0", 0: "q0", 1: "q1", 2: "q2"}
    picks = [F.max(F.when(F.col("s") == s, F.col("ym") / 1000.0)).alias(n) for s, n in names.items()]
    return deal(at, "video_id", "f").join(by_sort(luma), list(PIXEL)).groupBy("video_id", "f", "ex", "ey").agg(*picks)


def deblock_pass(luma: DataFrame, vectors: DataFrame, vertical: bool, alpha: int = 28, beta: int = 29, c: int = 4) -> DataFrame:
    """One smoothing pass over a snapshot; the thresholds are those of strength 7 with offsets 4 and 51."""
    e = edge_neighbours(luma, vectors, vertical).where(f"abs(p0 - q0) < {alpha} AND abs(p1 - p0) < {beta} AND abs(q0 - q1) < {beta}")
    i = lambda n: F.col(n).cast("int")
    soft_q, soft_p = F.abs(F.col("q0") - F.col("q2")) < beta, F.abs(F.col("p0") - F.col("p2")) < beta
    cd = F.lit(c) + soft_q.cast("int") + soft_p.cast("int")
    mean = F.shiftright((F.col("q0") + F.col("p0") + 1).cast("int"), 1)
    delta = F.shiftright(F.shiftleft((F.col("q0") - F.col("p0")).cast("int"), 2) + (F.col("p1") - F.col("q1")).cast("int") + 4, 3)
    delta = F.greatest(F.least(delta, cd), -cd)
    outer = lambda far, near: clamp(F.shiftright((F.col(far) + mean - F.shiftleft(i(near), 1)).cast("int"), 1), -c, c)
    fit = lambda x: clamp(x, 0, 255) * 1000
    moved = F.array(
        F.struct(F.lit(-1).alias("s"), fit(i("p0") + delta).alias("v")),
        F.struct(F.lit(0).alias("s"), fit(i("q0") - delta).alias("v")),
        F.struct(F.lit(1).alias("s"), F.when(soft_q, fit(i("q1") + outer("q2", "q1"))).alias("v")),
        F.struct(F.lit(-2).alias("s"), F.when(soft_p, fit(i("p1") + outer("p2", "p1"))).alias("v")),
    )
    new = e.select("video_id", "f", "ex", "ey", F.explode(moved).alias("m")).where("m.v IS NOT NULL")
    new = new.selectExpr("video_id", "f", *(("ex AS x", "ey + m.s AS y") if vertical else ("ex + m.s AS x", "ey AS y")), "CAST(m.v AS BIGINT) AS ym")
    return overlay(luma, new)


def deblock(luma: DataFrame, vectors: DataFrame, **limits: int) -> DataFrame:
    """All column edges on one snapshot, then all row edges on the result."""
    return deblock_pass(deblock_pass(luma, vectors, False, **limits), vectors, True, **limits)


#: Pixels around a tile that edges on its border reach, in the one pass and the other.
HALO = 4


def smoothed(t: DataFrame, vectors: DataFrame, passes: str = "xy", size: int = 32, alpha: int = 28, beta: int = 29, c: int = 4) -> DataFrame:
    """``deblock`` of tiles: (TILE, ym), and ``um``, ``vm`` if the tiles are not packed; ``passes`` names the edges smoothed, columns x and rows y.

    A tile gets the border strips of its neighbours and the list of the coded
    blocks whose edges reach it, so that both passes need no more than its row.
    """
    packed = "rgb" in t.columns
    kinds = ", ".join(f"{n} {k}" for n, k in t.select(*tiles.TILE).dtypes)
    sent = t.select(*tiles.TILE, *(("has", "rgb") if packed else ("ym", "um", "vm"))).mapInArrow(partial(_borders, size=size), f"{kinds}, kind int, luma binary, chroma binary")
    parts = sent.groupBy(*tiles.TILE).agg(F.collect_list(F.struct("kind", "luma", "chroma")).alias("parts")).where("exists(parts, p -> p.kind = 4)")  # nine at most
    near = vectors.selectExpr("video_id", "f", "pos_x + span_x AS x", "pos_y + span_y AS y", "size").where("x > 0 AND y > 0").distinct()
    for n in "xy":
        near = near.withColumn(f"t{n}", F.explode(F.expr(f"sequence(CAST(greatest(0, {n} - {HALO}) div {size} AS INT), CAST(({n} + size + {HALO} - 1) div {size} AS INT))")))
    lists = near.groupBy(*tiles.TILE).agg(F.collect_list(F.struct("x", "y", "size")).alias("bs"))  # at most the cells of a tile and its border
    both = parts.join(by_sort(lists), list(tiles.TILE), "left").select(*tiles.TILE, "parts", "bs")
    planes = ("ym",) if packed else ("ym", "um", "vm")
    run = partial(_smoothed, size=size, passes=passes, planes=planes, limits=(1000 * alpha, 1000 * beta, c))
    return both.mapInArrow(run, f"{kinds}, " + ", ".join(f"{p} array<int>" for p in planes))


def _borders(batches: Iterator, size: int) -> Iterator:
    """Tiles and what each of their eight neighbours needs of them; kind 4 is the tile itself."""
    import numpy as np
    import pyarrow as pa

    kept = {-1: slice(size - HALO, size), 0: slice(0, size), 1: slice(0, HALO)}
    for batch in batches:
        for start in range(0, batch.num_rows, tiles.SOME):
            part = batch.slice(start, tiles.SOME)
            tx, ty = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            chroma = np.zeros((len(tx), 0), np.int32)
            if part.num_columns == 6:
                luma = tiles.packed_luma(part.column(4), part.column(5), size)
            else:
                luma, *both = (tiles._plane(part.column(4 + k), size // n) for k, n in enumerate((1, 2, 2)))
                chroma = np.concatenate([p.reshape(len(tx), -1) for p in both], axis=1)
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    rows, kind = np.flatnonzero((tx >= i) & (ty >= j)), 3 * i + j + 4
                    if len(rows):
                        named = part.select(["video_id", "f"]).take(pa.array(rows)).columns
                        at = [pa.array((tx - i)[rows], part.column(2).type), pa.array((ty - j)[rows], part.column(3).type)]
                        cut = [luma[rows][:, kept[j], kept[i]].reshape(len(rows), -1), chroma[rows] if kind == 4 else chroma[rows, :0]]
                        yield pa.RecordBatch.from_arrays([*named, *at, pa.array(np.full(len(rows), kind, np.int32)), *(tiles._binary(tiles._thin(v)) for v in cut)], [*tiles.TILE, "kind", "luma", "chroma"])


def _smoothed(batches: Iterator, size: int, passes: str, planes: tuple, limits: tuple) -> Iterator:
    import numpy as np
    import pyarrow as pa

    wide, put = size + 2 * HALO, {-1: slice(0, HALO), 0: slice(HALO, HALO + size), 1: slice(HALO + size, size + 2 * HALO)}
    side = {-1: HALO, 0: size, 1: HALO}
    for batch in batches:
        for start in range(0, batch.num_rows, tiles.SOME):
            part = batch.slice(start, tiles.SOME)
            n, parts, bs = part.num_rows, part.column(4), part.column(5)
            luma = np.full((n, wide, wide), tiles.GONE, np.int64)
            t, flat = np.repeat(np.arange(n), parts.value_lengths().to_numpy(zero_copy_only=False)), parts.flatten()
            kinds = flat.field("kind").to_numpy(zero_copy_only=False)
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    rows = np.flatnonzero(kinds == 3 * i + j + 4)
                    if len(rows):
                        got = tiles._bytes(flat.field("luma").take(pa.array(rows)), 4 * side[i] * side[j])
                        luma[t[rows], put[j], put[i]] = tiles._thick(got).reshape(-1, side[j], side[i])
            blocks, t = bs.flatten(), np.repeat(np.arange(n), bs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            sizes, xs, ys = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("size", "x", "y"))
            xs, ys = (c - part.column(i).to_numpy(zero_copy_only=False)[t] * size + HALO for c, i in ((xs, 2), (ys, 3)))
            for axis in passes:
                edge, across, along = np.zeros((n, wide, wide), bool), *((xs, ys) if axis == "x" else (ys, xs))
                for s in np.unique(sizes):
                    rows = np.flatnonzero((sizes == s) & (across >= 3) & (across < wide - 2))
                    line = along[rows][:, None] + np.arange(s)
                    row, at = np.nonzero((line >= 0) & (line < wide))
                    edge[t[rows][row], line[row, at], across[rows][row]] = True  # lines along the edge come first
                smooth(luma if axis == "x" else luma.swapaxes(1, 2), edge, limits)
            out = luma[:, put[0], put[0]].reshape(n, -1)
            lists = [tiles._listed(out, out != tiles.GONE)]
            if len(planes) > 1:
                chroma = tiles._thick(tiles._bytes(flat.field("chroma").take(pa.array(np.flatnonzero(kinds == 4))), 2 * size * size)).reshape(n, 2, -1)
                lists += [tiles._listed(chroma[:, k], chroma[:, k] != tiles.GONE) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *lists], [*tiles.TILE, *planes])


def smooth(luma, edge, limits: tuple) -> None:
    """One pass over a snapshot of (tile, line, place) in thousandths: ``edge`` marks the places with an edge before them."""
    import numpy as np

    alpha, beta, c = limits
    t, line, x = np.nonzero(edge)
    p2, p1, p0, q0, q1, q2 = (luma[t, line, x + s] for s in range(-3, 3))
    gone = lambda a: a == tiles.GONE
    on = ~(gone(p1) | gone(p0) | gone(q0) | gone(q1)) & (abs(p0 - q0) < alpha) & (abs(p1 - p0) < beta) & (abs(q0 - q1) < beta)
    t, line, x, p2, p1, p0, q0, q1, q2 = (a[on] for a in (t, line, x, p2, p1, p0, q0, q1, q2))
    whole = lambda a: np.sign(a) * (abs(a) // 1000)
    soft_p, soft_q = ~gone(p2) & (abs(p0 - p2) < beta), ~gone(q2) & (abs(q0 - q2) < beta)
    mean = whole(q0 + p0 + 1000) >> 1
    delta = (whole(q0 - p0) * 4 + whole(p1 - q1) + 4) >> 3
    cd = c + soft_p.astype(np.int64) + soft_q
    delta = np.where(gone(p2) | gone(q2), delta, np.clip(delta, -cd, cd))  # as in the SQL, where an unknown limit limits nothing
    fit = lambda a: np.clip(a, 0, 255) * 1000
    outer = lambda far, near: np.clip(whole(far + 1000 * (mean - 2 * whole(near))) >> 1, -c, c)
    for s, new, some in ((-1, fit(whole(p0) + delta), None), (0, fit(whole(q0) - delta), None), (1, fit(whole(q1) + outer(q2, q1)), soft_q), (-2, fit(whole(p1) + outer(p2, p1)), soft_p)):
        rows = slice(None) if some is None else some
        luma[t[rows], line[rows], x[rows] + s] = new[rows]
