"""Frames as square tiles of pixel arrays, and what is computed inside a tile without a shuffle.

A tile is one row with its pixels row by row, null outside the frame.  Blocks of
the adaptive partition and their changes against the previous frame are
expressions over these arrays; only whole tiles and their strips move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import frame_index
from ..sources.shared import by_sort, deal

TILE = ("video_id", "f", "tx", "ty")
LEAF = ("video_id", "f", "x", "y", "size")


def frame_tiles(pixels: DataFrame, size: int = 32) -> DataFrame:
    """(video_id, f, tx, ty, r, g, b, ym, um, vm, has, rgb): ``size`` x ``size`` arrays, chroma half as wide, in thousandths.

    Tasks pack their pixels before the one shuffle (``packed``).  Chroma cells
    take their pixels in raster order, with weights 1, 1, 2 and 4 of eight.
    Array functions computed the planes in boxed numbers; numpy takes many
    tiles at a time.
    """
    return _from_packed(pixels, size, _filled, [*"rgb", "ym", "um", "vm"], *_PACKED)


def leafy_tiles(pixels: DataFrame, size: int = 32, threshold: int = 45, least: int = 4, planes: bool = True) -> DataFrame:
    """``with_leaves`` of ``frame_tiles``, of one pass: colours needn't leave it, nor ``planes`` for what takes packed tiles."""
    return _from_packed(pixels, size, partial(_filled_leaves, threshold=threshold, least=least, planes=planes), ["ym", "um", "vm"] if planes else [], _LEAVES, *_PACKED)


def leaf_rows(pixels: DataFrame, size: int = 32, threshold: int = 45, least: int = 4) -> DataFrame:
    """The leaves of the partition as rows (video_id, f, x, y, size, r, g, b); no planes are made."""
    found = _from_packed(pixels, size, partial(_filled_leaves, threshold=threshold, least=least, planes=False), [], _LEAVES)
    return found.select("video_id", "f", F.inline_outer("leaves"))  # never empty


#: Tiles that numpy takes at a time.
SOME = 256

_LEAVES = "leaves array<struct<" + ", ".join(f"{c}: int" for c in ("x", "y", "size", "r", "g", "b")) + ">>"


#: What ``packed`` has of a tile stays with it: a third of the planes' bytes to shuffle, and they compress.
_PACKED = ("has binary", "rgb binary")


def packed(pixels: DataFrame, size: int, lines: bool = True) -> DataFrame:
    """(video_id, f, tx, ty, has, rgb): what each task has of a tile, once a batch of its rows.

    ``has`` has a bit and ``rgb`` a byte a plane for every place of the tile.
    With ``lines``, eight pixels of a line become one row first, by plain
    aggregates: a list of a tile's pixels had to be sorted, and Arrow takes rows
    one by one.  Streams keep no aggregates here and go without.
    """
    tile = [F.expr(f"CAST(x div {size} AS INT) AS tx"), F.expr(f"CAST(y div {size} AS INT) AS ty")]
    px = "CAST(r * 65536 + g * 256 + b AS BIGINT) + 16777216"
    if lines:
        line = F.expr(f"CAST((y % {size}) * {size // 8} + x % {size} div 8 AS INT) AS line")
        keyed = pixels.select("video_id", "f", *tile, line, F.expr("CAST(x % 8 AS INT) AS at"), F.expr(f"{px} AS px"))
        got = keyed.groupBy(*TILE, "line").agg(*[F.max(F.when(F.col("at") == k, F.col("px"))).alias(f"p{k}") for k in range(8)])
        got = got.select(*TILE, "line", *[F.expr(f"coalesce(p{k}, 0L) + shiftleft(coalesce(p{k + 1}, 0L), 25) AS p{k}") for k in (0, 2, 4, 6)])
    else:
        got = pixels.select("video_id", "f", *tile, F.expr(f"shiftleft(CAST((y % {size}) * {size} + x % {size} AS BIGINT), 25) + {px} AS px"))
    kinds = ", ".join(f"{c} {t}" for c, t in got.select(*TILE).dtypes)
    return got.mapInArrow(partial(_packs, size=size), f"{kinds}, has binary, rgb binary")


def _binary(rows):
    """A column of binary values of one length from rows of bytes."""
    import numpy as np
    import pyarrow as pa

    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column, n: int):
    """Rows of ``n`` bytes of a column of binary values of that length."""
    import numpy as np

    return np.frombuffer(column.buffers()[2], np.uint8)[n * column.offset :][: n * len(column)].reshape(len(column), n)


def _starts(keys: list):
    """Rows at which one of the columns changes, and 0."""
    import numpy as np

    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _packs(batches: Iterator, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    low = (1 << 25) - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if len(cols) == 5:  # single pixels
            colour, place = (cols[4] & low)[:, None], (cols[4] >> 25)[:, None]
        else:
            pairs = np.stack(cols[5:], axis=1)
            colour, place = np.stack([pairs & low, pairs >> 25], axis=2).reshape(-1, 8), cols[4][:, None] * 8 + np.arange(8)
        order = np.lexsort(cols[3::-1])
        keys, colour, place = [k[order] for k in cols[:4]], colour.astype(np.int32)[order], place[order]
        starts = _starts(keys)
        ends = np.append(starts[1:], len(order))
        for at in range(0, len(starts), SOME):
            first, last = starts[at : at + SOME], ends[at : at + SOME]
            rows, n = slice(first[0], last[-1]), len(first)
            spot = np.repeat(np.arange(n), last - first)[:, None], place[rows]
            has, rgb = np.zeros((n, size * size), bool), np.zeros((n, 3, size * size), np.uint8)
            has[spot] = colour[rows] >> 24
            for k in range(3):
                rgb[:, k][spot] = colour[rows] >> (16 - 8 * k) & 255
            named = batch.select(list(TILE)).take(pa.array(order[first])).columns
            yield pa.RecordBatch.from_arrays([*named, _binary(np.packbits(has, axis=1)), _binary(rgb.reshape(n, -1))], [*TILE, "has", "rgb"])


def _from_packed(pixels: DataFrame, size: int, make, planes: list[str], *more: str) -> DataFrame:
    """Tiles whose ``planes`` and further columns ``make`` fills from (has, colours) of many tiles."""
    # in the order of their tiles, so that a task has one tile at a time to put together
    rows = packed(pixels, size).repartition(*TILE).sortWithinPartitions(*TILE)
    kinds = [f"{c} {t}" for c, t in rows.select(*TILE).dtypes]
    names = [*TILE, *planes, *(m.split()[0] for m in more)]
    return rows.mapInArrow(partial(_put_together, size=size, make=make, names=names), ", ".join([*kinds, *(f"{p} array<int>" for p in planes), *more]))


def _put_together(batches: Iterator, size: int, make, names: list[str]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    places = size * size

    def made(keys, has: np.ndarray, rgb: np.ndarray) -> Iterator:
        for at in range(0, len(has), SOME):
            some = keys.slice(at, SOME)
            known = np.unpackbits(has[at : at + SOME], axis=1, count=places).view(bool)
            colours = rgb[at : at + SOME].reshape(-1, 3, places).swapaxes(0, 1)
            carried = (_binary(has[at : at + SOME]), _binary(rgb[at : at + SOME])) if names[-1] == "rgb" else ()
            yield pa.RecordBatch.from_arrays([*some.columns, *make(some, known, colours, size), *carried], names)

    kept = None  # the last tile, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, has, rgb = batch.select(list(TILE)), _bytes(batch.column(4), -(-places // 8)), _bytes(batch.column(5), 3 * places)
        if kept is not None:
            keys = pa.Table.from_batches([kept[0], keys]).combine_chunks().to_batches()[0]
            has, rgb = np.concatenate([kept[1], has]), np.concatenate([kept[2], rgb])
        starts = _starts([c.to_numpy(zero_copy_only=False) for c in keys.columns])
        if len(starts) < len(has):
            many, every = np.diff(np.append(starts, len(has))), (has, rgb)
            has, rgb = has[starts], rgb[starts]
            for k in range(1, many.max()):
                rows = np.flatnonzero(many > k)
                more = every[0][starts[rows] + k]
                known = np.unpackbits(more, axis=1, count=places).view(bool)[:, None, :]
                rgb[rows] = np.where(known, every[1][starts[rows] + k].reshape(-1, 3, places), rgb[rows].reshape(-1, 3, places)).reshape(len(rows), -1)
                has[rows] |= more
            keys = keys.take(pa.array(starts))
        n = len(has) - 1
        yield from made(keys.slice(0, n), has[:n], rgb[:n])
        kept = keys.slice(n), has[n:].copy(), rgb[n:].copy()
    if kept is not None:
        yield from made(*kept)


def _listed(values, known):
    """A column of arrays, null where nothing is known."""
    import numpy as np
    import pyarrow as pa

    flat = pa.array(values.ravel().astype(np.int32), pa.int32(), mask=None if known.all() else ~known.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, values.shape[1], dtype=np.int32)), flat)


def listed(values):
    """A column of arrays of one length."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def planes_of(has, colours, size: int) -> list:
    """(values, known) of luma and chroma in thousandths; eight chroma values in millionths fit 31 bits."""
    import numpy as np

    n, half = len(has), size // 2
    r, g, b = (c.astype(np.int32) for c in colours)
    square = lambda a: a.reshape(n, half, 2, half, 2)
    inside = square(has)[:, :, 0, :, 0].reshape(n, -1)
    cells = []
    for micro in (128_000_000 - 168_736 * r - 331_264 * g + 500_000 * b, 128_000_000 + 500_000 * r - 418_688 * g - 81_312 * b):
        c = square(micro if has.all() else micro * has)
        cells.append((c[:, :, 0, :, 0] + c[:, :, 0, :, 1] + 2 * c[:, :, 1, :, 0] + 4 * c[:, :, 1, :, 1]).reshape(n, -1) // 8000)
    return [(299 * r + 587 * g + 114 * b, has), (cells[0], inside), (cells[1], inside)]


def _filled(keys, has, colours, size: int) -> list:
    return [*(_listed(c, has) for c in colours), *(_listed(v, k) for v, k in planes_of(has, colours, size))]


def _filled_leaves(keys, has, colours, size: int, threshold: int, least: int, planes: bool) -> list:
    leaves = _leaves_of(*(keys.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)), has, colours, size, threshold, least)
    return [*((_listed(v, k) for v, k in planes_of(has, colours, size)) if planes else ()), leaves]


def _places(size: int) -> tuple[list[int], list[int]]:
    """Columns and rows of a tile's 4x4 cells in depth-first order, columns first."""
    xs, ys, step = [0], [0], 1
    while step < size // 4:
        xs, ys = [x + step * i for i in (0, 1) for _ in (0, 1) for x in xs], [y + step * j for _ in (0, 1) for j in (0, 1) for y in ys]
        step *= 2
    return xs, ys


def with_leaves(tiles: DataFrame, size: int = 32, threshold: int = 45, least: int = 4) -> DataFrame:
    """Tiles (TILE, ym, um, vm) with ``leaves``, an array of (x, y, size, r, g, b): blocks split while their spread is above the threshold or they leave the frame.

    A pyramid inside the row: 4x4 cells are summed from pixels once (number,
    sums and square sums of colours, cell means), each level is the sum of fours
    of the level below, in depth-first order.  From the top down a block is
    alive while all its ancestors are split; alive blocks that aren't are leaves.
    """
    rows = tiles.select(*TILE, "ym", "um", "vm", *"rgb")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:7])
    return rows.mapInArrow(partial(_partitioned, size=size, threshold=threshold, least=least), f"{kinds}, {_LEAVES}")


def _partitioned(batches: Iterator, size: int, threshold: int, least: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            tx, ty, *rgb = (part.column(i) for i in (2, 3, 7, 8, 9))
            yield pa.RecordBatch.from_arrays([*part.columns[:7], _leaf_lists(tx.to_numpy(), ty.to_numpy(), rgb, size, threshold, least)], [*TILE, "ym", "um", "vm", "leaves"])


def _leaf_lists(tx, ty, rgb: list, size: int, threshold: int, least: int):
    import numpy as np

    flat = [c.flatten() for c in rgb]
    colours = [c.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(tx), -1) for c in flat]
    return _leaves_of(tx, ty, flat[0].is_valid().to_numpy(zero_copy_only=False).reshape(len(tx), -1), np.stack(colours), size, threshold, least)


def _leaves_of(tx, ty, has, colours, size: int, threshold: int, least: int):
    import numpy as np
    import pyarrow as pa

    n = len(tx)
    xs, ys = (4 * np.array(v) for v in _places(size))

    def cells(a: np.ndarray) -> np.ndarray:
        """Sums of 4x4 pixels, which fit 32 bits, in depth-first order."""
        a = a.reshape(n, size, size)
        wide = a[:, 0::4] + a[:, 1::4] + a[:, 2::4] + a[:, 3::4]
        return (wide[:, :, 0::4] + wide[:, :, 1::4] + wide[:, :, 2::4] + wide[:, :, 3::4])[:, ys // 4, xs // 4].astype(np.int64)

    count = np.full((n, len(xs)), 16) if has.all() else cells(has.astype(np.int32))
    wide = [c.astype(np.int32) for c in colours]
    sums, squares = [cells(c) for c in wide], [cells(c * c) for c in wide]
    found = [count, (count > 0).astype(np.int64), *sums, *squares, *(c // 16 for c in sums)]
    levels = {4: found}
    for s in range(3, size.bit_length()):
        levels[1 << s] = [a.reshape(n, -1, 4).sum(axis=2) for a in levels[1 << (s - 1)]]
    split, rows, s = None, [], size
    while s >= least:
        count, k, *rest = levels[s]
        sums, squares, means = rest[:3], rest[3:6], [np.floor(m / np.maximum(k, 1) + 0.5).astype(np.int64) for m in rest[6:]]
        alive = count > 0 if split is None else (count > 0) & np.repeat(split, 4, axis=1)
        spread = sum(q - 2 * c * t + count * c * c for q, c, t in zip(squares, means, sums, strict=True))
        split = alive & ((spread > threshold * threshold * count) | (count < s * s)) if s > least else np.zeros_like(alive)
        t, i = np.nonzero(alive & ~split)
        step = (s // 4) ** 2
        rows.append(np.stack([t, tx[t] * size + xs[::step][i], ty[t] * size + ys[::step][i], np.full(len(t), s), *(c[t, i] for c in means)]))
        s //= 2
    got = np.concatenate(rows, axis=1)
    got = got[:, np.argsort(got[0], kind="stable")].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(np.bincount(got[0], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in got[1:]], ["x", "y", "size", "r", "g", "b"]))


def grid(tiles: DataFrame, block: int = 8, size: int = 32) -> DataFrame:
    """Tiles whose ``leaves`` are all blocks of one size that have a pixel in the frame."""
    n = size // block
    places = f"transform(sequence(0, {n * n - 1}), i -> named_struct('x', tx * {size} + (i div {n}) * {block}, 'y', ty * {size} + (i % {n}) * {block}, 'size', {block}))"
    return tiles.withColumn("leaves", F.expr(f"filter({places}, l -> ym[(l.y - ty * {size}) * {size} + l.x - tx * {size}] IS NOT NULL)"))


def _cut_out(plane: str, stride: int, x: str, y: str, n: str) -> str:
    """A square of a plane, row by row."""
    return f"flatten(transform(sequence(0, {n} - 1), j -> slice({plane}, CAST(({y} + j) * {stride} + {x} + 1 AS INT), {n})))"


def block_change(tiles: DataFrame, before: DataFrame | None = None, index: DataFrame | None = None, size: int = 32) -> DataFrame:
    """Squared differences of every leaf to the same pixels of the previous frame: sy, su, sv (null if that lacks one) and the numbers of pixels ny, nu.

    ``before`` has the tiles of earlier frames, if they are others than
    ``tiles`` itself, and ``index`` each frame's predecessor.
    """
    return _compared(tiles, before, index, size, [(c, "bigint") for c in ("sy", "ny", "su", "sv", "nu")])


def _compared(tiles: DataFrame, before: DataFrame | None, index: DataFrame | None, size: int, more: list[tuple[str, str]]) -> DataFrame:
    """Leaves with the ``more`` columns of ``_leaf_changes``.

    Tiles take their place's tile before by one shuffle; that it is of the
    frame before is held against the index on the leaves, which are narrow.
    """
    index = frame_index(tiles) if index is None else index
    index = index.where("prev_f IS NOT NULL").select("video_id", "f", "prev_f")
    places = [F.expr(f"leaves.{c}").alias(c) for c in ("x", "y", "size")]
    kinds = [(c, t.removeprefix("array<").removesuffix(">")) for c, t in tiles.select(*TILE, *places, F.col("f").alias("prev_f")).select(*LEAF, "prev_f").dtypes]
    schema, own = ", ".join(f"{c} {t}" for c, t in kinds + more), "yb" in dict(more)
    was = [F.col(p).alias(p + "0") for p in ("ym", "um", "vm")]
    if before is not None:
        before = deal(before.select("video_id", F.col("f").alias("prev_f"), "tx", "ty", *was), "video_id")  # a few frames a video
        both = deal(tiles, "video_id").join(by_sort(deal(index, "video_id")), ["video_id", "f"]).join(by_sort(before), ["video_id", "prev_f", "tx", "ty"])
    elif "rgb" in tiles.columns:
        spot = ("video_id", "tx", "ty")
        rows = tiles.select(*TILE, "has", "rgb", *places).repartition(*spot).sortWithinPartitions(*spot, "f")
        found = rows.mapInArrow(partial(_packed_changes, size=size, own=own), schema)
        return found.join(by_sort(index), ["video_id", "f", "prev_f"]).select(*LEAF, *[c for c, _ in more])
    else:
        last = F.lag(F.struct(F.col("f").alias("prev_f"), *was)).over(Window.partitionBy("video_id", "tx", "ty").orderBy("f"))
        both = tiles.withColumn("was", last).where("was IS NOT NULL").select("*", "was.*")
    rows = both.select(*TILE, "prev_f", "ym", "um", "vm", "ym0", "um0", "vm0", *places)
    found = rows.mapInArrow(partial(_leaf_changes, size=size, own=own), schema)
    return found.drop("prev_f") if before is not None else found.join(by_sort(index), ["video_id", "f", "prev_f"]).select(*LEAF, *[c for c, _ in more])


def _packed_changes(batches: Iterator, size: int, own: bool) -> Iterator:
    """``_leaf_changes`` of packed tiles in the order of their places and frames; a batch's last tile is kept for the next one's first."""
    import numpy as np
    import pyarrow as pa

    kept = None
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            keys = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            bits, rgb = _bytes(part.column(4), -(-size * size // 8)), _bytes(part.column(5), 3 * size * size)
            has = np.unpackbits(bits, axis=1, count=size * size).view(bool)
            made = planes_of(has, rgb.reshape(-1, 3, size * size).swapaxes(0, 1), size)
            made = [tuple(a.reshape(len(a), size // n, -1) for a in (v * k, k)) for (v, k), n in zip(made, (1, 2, 2), strict=True)]
            if kept is None:
                kept = keys[:, :1], [(v[:1], k[:1]) for v, k in made]
                rows = np.arange(1, len(has))
            else:
                rows = np.arange(len(has))
            first = len(has) - len(rows)
            before = np.concatenate([kept[0], keys[:, first:-1]], axis=1) if len(rows) else keys[:, :0]
            same = (keys[[0, 2, 3]][:, rows] == before[[0, 2, 3]]).all(axis=0)
            rows, prev = rows[same], before[1][same]
            if len(rows):
                was = [tuple(np.concatenate([o, a[first:-1]])[same] for o, a in zip(old, now, strict=True)) for old, now in zip(kept[1], made, strict=True)]
                mine = part.take(pa.array(rows))
                col = dict(zip(mine.schema.names, mine.columns, strict=True)) | {"prev_f": pa.array(prev, part.schema.field("f").type)}
                yield from _changes_of(col, [tuple(a[rows] for a in now) for now in made], was, size, own)
            kept = keys[:, -1:], [(v[-1:], k[-1:]) for v, k in made]


def _leaf_changes(batches: Iterator, size: int, own: bool) -> Iterator:
    """Sums of every leaf, or with ``own`` the pixels of those that have changed."""
    import numpy as np

    def plane(lists, side: int) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten()
        values, known = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
        return values.astype(np.int64).reshape(-1, side, side), known.reshape(-1, side, side)

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            col = dict(zip(part.schema.names, part.columns, strict=True))
            now, was = ([plane(col[p + old], size // n) for p, n in (("ym", 1), ("um", 2), ("vm", 2))] for old in ("", "0"))
            yield from _changes_of(col, now, was, size, own)


def _changes_of(col: dict, all_now: list, all_was: list, size: int, own: bool) -> Iterator:
    """Changes of the leaves of some tiles from (values, known) of their planes and of those before."""
    import numpy as np
    import pyarrow as pa

    def summed(a: np.ndarray) -> np.ndarray:
        """Sums of all that lies above and left, so that four of them give any block's sum."""
        out = np.zeros((a.shape[0], a.shape[1] + 1, a.shape[2] + 1), np.int64)
        out[:, 1:, 1:] = a.cumsum(1, dtype=np.int64).cumsum(2)
        return out

    def squares(values: np.ndarray, known: np.ndarray, t, i, j, side: int):
        """The pixels of blocks of one size, row by row, null outside the frame."""
        at = t[:, None, None], j[:, None, None] + np.arange(side)[:, None], i[:, None, None] + np.arange(side)
        flat = pa.array(values[at].ravel().astype(np.int32), mask=~known[at].ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, side * side, dtype=np.int32)), flat)

    places = [col[c].flatten() for c in ("x", "y", "size")]
    t = np.repeat(np.arange(len(col["x"])), col["x"].value_lengths().to_numpy(zero_copy_only=False))
    x, y, k = (a.to_numpy(zero_copy_only=False) for a in places)
    x, y = x - size * col["tx"].to_numpy()[t], y - size * col["ty"].to_numpy()[t]
    out, planes, moved = {}, {}, np.zeros(len(t), bool)
    for (now, inside), (was, had), (name, n, most) in zip(all_now, all_was, (("ym", 1, 1_550_000), ("um", 2, 3_600_000), ("vm", 2, 3_600_000)), strict=True):
        i, j, m = x // n, y // n, k // n
        of_leaves = lambda a: (s := summed(a))[t, j + m, i + m] - s[t, j, i + m] - s[t, j + m, i] + s[t, j, i]  # noqa: B023, E731
        square, lacks, many = of_leaves(np.where(inside & had, now - was, 0).astype(np.int64) ** 2), of_leaves(inside & ~had) > 0, of_leaves(inside)
        out["s" + name[0]], out["n" + name[0]] = pa.array(square, pa.int64(), mask=lacks), pa.array(many, pa.int64())
        planes[name[0] + "b"] = (now, inside, n)
        moved |= ~lacks & (square > most * many)
    keys = lambda rows: [*(col[c].take(pa.array(t[rows])) for c in ("video_id", "f")), *(p.take(pa.array(rows)) for p in places), col["prev_f"].take(pa.array(t[rows]))]
    names = [*LEAF, "prev_f"]
    if not own:
        yield pa.RecordBatch.from_arrays([*keys(np.arange(len(t))), *(out[c] for c in ("sy", "ny", "su", "sv", "nu"))], [*names, "sy", "ny", "su", "sv", "nu"])
        return
    for side in np.unique(k[moved]):
        rows = np.flatnonzero(moved & (k == side))
        blocks = [squares(v, known, t[rows], x[rows] // n, y[rows] // n, int(side) // n) for v, known, n in planes.values()]
        yield pa.RecordBatch.from_arrays([*keys(rows), *blocks], [*names, *planes])


def changed_leaves(tiles: DataFrame, before: DataFrame | None = None, index: DataFrame | None = None, size: int = 32) -> DataFrame:
    """Leaves (video_id, f, x, y, size) with mean squares above 1.55 for luma or 3.6 for chroma; planes are in thousandths."""
    return block_change(tiles, before, index, size).where("sy > 1550000 * ny OR su > 3600000 * nu OR sv > 3600000 * nu").select(*LEAF)


def changed_blocks(tiles: DataFrame, before: DataFrame | None = None, index: DataFrame | None = None, size: int = 32) -> DataFrame:
    """``changed_leaves`` with their own pixels ``yb``, ``ub``, ``vb``, row by row, so that the search needn't shuffle whole tiles for them."""
    return _compared(tiles, before, index, size, [(c, "array<int>") for c in ("yb", "ub", "vb")])


def leaf_pixels(tiles: DataFrame, size: int = 32) -> DataFrame:
    """Every pixel with its leaf's mean colour, expanded from the tiles' leaves."""
    pixel = "named_struct('x', l.x + k % l.size, 'y', l.y + k div l.size, 'r', l.r, 'g', l.g, 'b', l.b)"
    each = f"flatten(transform(leaves, l -> transform(sequence(0, l.size * l.size - 1), k -> {pixel})))"
    inside = f"filter({each}, p -> ym[CAST((p.y - ty * {size}) * {size} + p.x - tx * {size} AS INT)] IS NOT NULL)"
    return tiles.select("video_id", "f", F.expr(f"inline_outer({inside})")).select("video_id", "f", F.col("x").cast("int"), F.col("y").cast("int"), "r", "g", "b")


def painted(tiles: DataFrame, blocks: DataFrame, size: int = 32) -> DataFrame:
    """Tiles with the pixels of some blocks (LEAF, yb, ub, vb) laid over them; blocks don't overlap."""
    at = [F.expr(f"CAST({c} div {size} AS INT) AS t{c}") for c in "xy"]
    lists = blocks.select("video_id", "f", *at, F.struct("x", "y", "size", "yb", "ub", "vb").alias("b")).groupBy(*TILE).agg(F.collect_list("b").alias("bs"))  # at most the cells of a tile
    return laid(tiles.select(*TILE, "ym", "um", "vm").join(by_sort(lists), list(TILE), "left"), size)


def laid(both: DataFrame, size: int = 32) -> DataFrame:
    """Tiles (TILE, ym, um, vm) with the list ``bs`` of their blocks laid over them."""
    kinds = ", ".join(f"{c} {t}" for c, t in both.select(*TILE).dtypes)
    return both.select(*TILE, "ym", "um", "vm", "bs").mapInArrow(partial(_laid, size=size), f"{kinds}, ym array<int>, um array<int>, vm array<int>")


def _laid(batches: Iterator, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            planes, bs = [_plane(part.column(4 + k), size // n).copy() for k, n in enumerate((1, 2, 2))], part.column(7)
            blocks, many = bs.flatten(), bs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            paint(planes, [part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], np.repeat(np.arange(part.num_rows), many), blocks, size)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *(_listed(p.reshape(len(p), -1), (p != GONE).reshape(len(p), -1)) for p in planes)], [*TILE, "ym", "um", "vm"])


def paint(planes: list, tile: list, t, blocks, size: int, names: tuple = ("yb", "ub", "vb")) -> None:
    """Blocks laid over the planes of their tiles ``t``, where both have pixels."""
    import numpy as np
    import pyarrow as pa

    sizes, xs, ys = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("size", "x", "y"))
    for s in np.unique(sizes):
        rows = np.flatnonzero(sizes == s)
        for plane, name, n in zip(planes, names, (1, 2, 2), strict=False):
            b, k = int(s) // n, t[rows]
            new = squares(blocks.field(name).take(pa.array(rows)), b * b).reshape(-1, b, b)
            y, x = ((c[rows] - tile[i][k] * size) // n for c, i in ((ys, 1), (xs, 0)))
            at = k[:, None, None], y[:, None, None] + np.arange(b)[:, None], x[:, None, None] + np.arange(b)
            plane[at] = np.where((plane[at] == GONE) | (new == GONE), plane[at], new)


def packed_luma(has, rgb, size: int):
    """Luma of packed tiles, ``GONE`` where there is no pixel."""
    import numpy as np

    known = np.unpackbits(_bytes(has, -(-size * size // 8)), axis=1, count=size * size).view(bool)
    r, g, b = _bytes(rgb, 3 * size * size).reshape(-1, 3, size * size).swapaxes(0, 1).astype(np.int32)
    return np.where(known, 299 * r + 587 * g + 114 * b, GONE).reshape(-1, size, size)


def luma_rows(tiles: DataFrame, size: int = 32) -> DataFrame:
    """(video_id, f, x, y, ym) of tiles that have the plane ``ym``."""
    y = tiles.select(*TILE, F.posexplode("ym").alias("k", "ym")).where("ym IS NOT NULL")
    return y.selectExpr("video_id", "f", f"CAST(tx * {size} + k % {size} AS INT) AS x", f"CAST(ty * {size} + k div {size} AS INT) AS y", "CAST(ym AS BIGINT) AS ym")


def to_planes(tiles: DataFrame, size: int = 32) -> tuple[DataFrame, DataFrame]:
    """(luma, chroma) as rows of pixels and cells."""
    half = size // 2
    c = tiles.select(*TILE, F.posexplode(F.arrays_zip("um", "vm")).alias("k", "c")).where("c.um IS NOT NULL")
    return luma_rows(tiles, size), c.selectExpr("video_id", "f", f"CAST(tx * {half} + k % {half} AS INT) AS cx", f"CAST(ty * {half} + k div {half} AS INT) AS cy", "c.um", "c.vm")


def with_luma(tiles: DataFrame, luma: DataFrame, size: int = 32) -> DataFrame:
    """Tiles with their luma taken from rows of pixels."""
    keyed = luma.selectExpr("video_id", "f", f"CAST(x div {size} AS INT) AS tx", f"CAST(y div {size} AS INT) AS ty", f"CAST((y % {size}) * {size} + x % {size} AS INT) AS p", "ym")
    got = keyed.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("p", "ym"))).alias("l"))
    got = got.withColumn("m", F.expr(f"CASE WHEN size(l) < {size * size} THEN map_from_arrays(l.p, l.ym) END"))
    plane = F.expr(f"CASE WHEN m IS NULL THEN l.ym ELSE transform(sequence(0, {size * size - 1}), i -> m[i]) END").alias("ym")
    return tiles.select(*TILE, "um", "vm").join(by_sort(got.select(*TILE, plane)), list(TILE)).select(*TILE, "ym", "um", "vm")


def block_arrays(blocks: DataFrame, tiles: DataFrame, size: int = 32) -> DataFrame:
    """Blocks (video_id, f, x, y, size) with their own pixels ``yb``, ``ub``, ``vb``, row by row."""
    keyed = blocks.withColumns({"tx": F.expr(f"CAST(x div {size} AS INT)"), "ty": F.expr(f"CAST(y div {size} AS INT)")})
    lists = keyed.groupBy(*TILE).agg(F.collect_list(F.struct("x", "y", "size")).alias("bs"))  # at most the cells of a tile
    part = lambda p, n: _cut_out(p, size // n, f"((l.x - tx * {size}) div {n})", f"((l.y - ty * {size}) div {n})", f"(l.size div {n})")
    cut = f"named_struct('x', l.x, 'y', l.y, 'size', l.size, 'yb', {part('ym', 1)}, 'ub', {part('um', 2)}, 'vb', {part('vm', 2)})"
    return lists.join(by_sort(tiles.select(*TILE, "ym", "um", "vm")), list(TILE)).select("video_id", "f", F.expr(f"inline_outer(transform(bs, l -> {cut}))"))


def packed_references(tiles: DataFrame, most: int, size: int = 32) -> DataFrame:
    """(video_id, ref_f, rx, ry, parts): what ``reference_tiles`` puts together, as packed parts (kind, has, rgb)."""
    kinds = ", ".join(f"{c} {t}" for c, t in tiles.select("video_id", F.col("f").alias("ref_f"), F.col("tx").alias("rx"), F.col("ty").alias("ry")).dtypes)
    sent = tiles.select(*TILE, "has", "rgb").mapInArrow(partial(_strips, most=most, size=size), f"{kinds}, kind int, has binary, rgb binary")
    got = sent.groupBy("video_id", "ref_f", "rx", "ry").agg(F.collect_list(F.struct("kind", "has", "rgb")).alias("parts"))  # four at most
    return got.where("exists(parts, p -> p.kind = 0)")


def plane_references(tiles: DataFrame, most: int, size: int = 32) -> DataFrame:
    """``packed_references`` of tiles that have planes only, as parts (kind, planes)."""
    kinds = ", ".join(f"{c} {t}" for c, t in tiles.select("video_id", F.col("f").alias("ref_f"), F.col("tx").alias("rx"), F.col("ty").alias("ry")).dtypes)
    sent = tiles.select(*TILE, "ym", "um", "vm").mapInArrow(partial(_plane_strips, most=most, size=size), f"{kinds}, kind int, planes binary")
    got = sent.groupBy("video_id", "ref_f", "rx", "ry").agg(F.collect_list(F.struct("kind", "planes")).alias("parts"))  # four at most
    return got.where("exists(parts, p -> p.kind = 0)")


def references(tiles: DataFrame, most: int, size: int = 32) -> DataFrame:
    """(video_id, ref_f, rx, ry, parts): tiles with ``most`` more columns and rows from their neighbours, in up to four parts.

    Any block of up to ``most`` pixels whose corner lies in the tile is whole in
    one row.  Neighbours send only the strips that are needed, and none beyond the frame.
    """
    return packed_references(tiles, most, size) if "rgb" in tiles.columns else plane_references(tiles, most, size)


#: In place of null in planes of whole numbers.
GONE = -(1 << 30)


def _plane(lists, side: int):
    """A column of squares as numbers, ``GONE`` in place of null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(lists.flatten().cast(pa.int32()), GONE).to_numpy(zero_copy_only=False).reshape(len(lists), side, -1)


def _thin(values):
    """Rows of numbers as bytes, all their lowest ones first: they compress."""
    import numpy as np

    return np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(len(values), -1, 4).swapaxes(1, 2).reshape(len(values), -1)


def _thick(rows):
    import numpy as np

    return np.ascontiguousarray(rows.reshape(len(rows), 4, -1).swapaxes(1, 2)).view("<i4")[:, :, 0]


def _plane_strips(batches: Iterator, most: int, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            tx, ty = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            planes = [_plane(part.column(4 + k), size // n) for k, n in enumerate((1, 2, 2))]
            for kind, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                rows = np.flatnonzero((tx >= i) & (ty >= j))
                if len(rows):
                    named = part.select(["video_id", "f"]).take(pa.array(rows)).columns
                    w, h = most if i else size, most if j else size
                    cut = _thin(np.concatenate([p[rows][:, : h // n, : w // n].reshape(len(rows), -1) for p, n in zip(planes, (1, 2, 2), strict=True)], axis=1))
                    at_tile = [pa.array((tx - i)[rows], part.column(2).type), pa.array((ty - j)[rows], part.column(3).type)]
                    yield pa.RecordBatch.from_arrays([*named, *at_tile, pa.array(np.full(len(rows), kind, np.int32)), _binary(cut)], ["video_id", "ref_f", "rx", "ry", "kind", "planes"])


def _strips(batches: Iterator, most: int, size: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            part = batch.slice(at, SOME)
            tx, ty = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            has = np.unpackbits(_bytes(part.column(4), -(-size * size // 8)), axis=1, count=size * size).reshape(-1, size, size)
            rgb = _bytes(part.column(5), 3 * size * size).reshape(-1, 3, size, size)
            for kind, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                rows = np.flatnonzero((tx >= i) & (ty >= j))
                if len(rows):
                    named = part.select(["video_id", "f"]).take(pa.array(rows)).columns
                    w, h = most if i else size, most if j else size
                    cut = [np.packbits(has[rows][:, :h, :w].reshape(len(rows), -1), axis=1), rgb[rows][:, :, :h, :w].reshape(len(rows), -1)]
                    at_tile = [pa.array((tx - i)[rows], part.column(2).type), pa.array((ty - j)[rows], part.column(3).type)]
                    yield pa.RecordBatch.from_arrays([*named, *at_tile, pa.array(np.full(len(rows), kind, np.int32)), *map(_binary, cut)], ["video_id", "ref_f", "rx", "ry", "kind", "has", "rgb"])


def _wide_planes(parts, side: int, most: int) -> list:
    """Planes of tiles and their neighbours' strips, ``GONE`` where there is no pixel."""
    import numpy as np
    import pyarrow as pa

    n, wide = len(parts), side + most
    t, flat = np.repeat(np.arange(n), parts.value_lengths().to_numpy(zero_copy_only=False)), parts.flatten()
    kinds = flat.field("kind").to_numpy(zero_copy_only=False)
    packed = flat.type.get_field_index("rgb") >= 0
    if packed:
        has, rgb = np.zeros((n, wide, wide), bool), np.zeros((3, n, wide, wide), np.uint8)
    else:
        planes = [np.full((n, wide // k, wide // k), GONE, np.int32) for k in (1, 2, 2)]
    for kind, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        w, h, at = most if i else side, most if j else side, pa.array(rows)
        if packed:
            x, y = slice(side * i, side * i + w), slice(side * j, side * j + h)
            has[t[rows], y, x] = np.unpackbits(_bytes(flat.field("has").take(at), -(-w * h // 8)), axis=1, count=w * h).reshape(-1, h, w)
            rgb[:, t[rows], y, x] = _bytes(flat.field("rgb").take(at), 3 * w * h).reshape(-1, 3, h, w).swapaxes(0, 1)
        else:
            values, first = _thick(_bytes(flat.field("planes").take(at), 6 * w * h)), 0
            for plane, k in zip(planes, (1, 2, 2), strict=True):
                x, y, many = slice(side * i // k, (side * i + w) // k), slice(side * j // k, (side * j + h) // k), w * h // (k * k)
                plane[t[rows], y, x] = values[:, first : first + many].reshape(-1, h // k, w // k)
                first += many
    if not packed:
        return planes
    return [np.where(known, v, GONE).reshape(n, wide // k, -1) for (v, known), k in zip(planes_of(has.reshape(n, -1), rgb.reshape(3, n, -1), wide), (1, 2, 2), strict=True)]


_COSTS = "video_id long, f int, x int, y int, size int, ref_f int, dx int, dy int, cost long"


def offset_costs(asked: DataFrame, refs: DataFrame, most: int, size: int = 32) -> DataFrame:
    """Costs of in-frame places in reference frames: (video_id, f, x, y, size, ref_f, dx, dy, cost).

    ``asked`` has blocks with arrays (``block_arrays``), ``ref_f`` and
    ``offsets``, an array of (dx, dy).  A cost is sy + 4 su + 4 sv, the summed
    mean squares times the block's pixels and 10**6; sums over the part of a
    block that is in the frame are scaled to the whole, rounded down, which
    does not change their order within a block.

    A tile of a reference frame meets the list of the blocks that ask it (at most
    its cells, their neighbours' and four frames' of them), and numpy takes the
    squares of blocks of one size at all offsets at once.  Parts cut out by
    array functions, a block at a time, took more than the squares.
    """
    spots = F.expr(f"transform(filter(offsets, o -> x + o.dx >= 0 AND y + o.dy >= 0), o -> named_struct('dx', CAST(o.dx AS SMALLINT), 'dy', CAST(o.dy AS SMALLINT), 'rx', CAST((x + o.dx) div {size} AS INT), 'ry', CAST((y + o.dy) div {size} AS INT)))")
    keyed = asked.withColumn("offsets", spots).withColumn("spot", F.explode(F.expr("array_distinct(transform(offsets, o -> struct(o.rx, o.ry)))")))
    mine = [F.expr(f"transform(filter(offsets, o -> o.rx = spot.rx AND o.ry = spot.ry), o -> o.d{c}) AS d{c}s") for c in "xy"]
    block = keyed.select("video_id", "ref_f", "spot.rx", "spot.ry", F.struct("f", "x", "y", "size", *mine, "yb", "ub", "vb").alias("block"))
    lists = block.groupBy("video_id", "ref_f", "rx", "ry").agg(F.collect_list("block").alias("blocks"))
    both = lists.join(by_sort(refs), ["video_id", "ref_f", "rx", "ry"])
    return both.select("video_id", "ref_f", "rx", "ry", "blocks", "parts").mapInArrow(partial(_costs, side=size, most=most), _COSTS)


def _costs(batches: Iterator, side: int, most: int) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            yield from _costs_of(batch.slice(at, SOME), side, most)


def _costs_of(batch, side: int, most: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def lists(column):
        """(values, first place of each row) of a column of arrays."""
        return pc.fill_null(column.flatten().cast(pa.int32()), GONE).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))

    video, ref, rx, ry = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    planes = _wide_planes(batch.column(5), side, most)
    blocks = batch.column(4).flatten()
    t = np.repeat(np.arange(batch.num_rows), batch.column(4).value_lengths().to_numpy(zero_copy_only=False))
    f, xs, ys, sizes = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("f", "x", "y", "size"))
    dxs, dys, yb, ub, vb = (lists(blocks.field(c)) for c in ("dxs", "dys", "yb", "ub", "vb"))
    keys, out = np.stack([video[t], f, xs, ys, sizes, ref[t]]).astype(np.int64), []
    _, kind = np.unique(np.stack([sizes, np.diff(dxs[1])], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
        s, k = int(sizes[same[0]]), int(dxs[1][same[0] + 1] - dxs[1][same[0]])
        many = max(1, 1_000_000 // (k * s * s))
        for rows in (same[j : j + many] for j in range(0, len(same), many)):
            at_row = lambda a, n: a[0][a[1][rows][:, None] + np.arange(n)]  # noqa: B023, E731
            dx, dy = at_row(dxs, k).astype(np.int64), at_row(dys, k).astype(np.int64)
            own = [at_row(c, (s // n) ** 2) for c, n in ((yb, 1), (ub, 2), (vb, 2))]
            ok, cost = place_costs(own, planes, t[rows], ys[rows][:, None] + dy - ry[t[rows]][:, None] * side, xs[rows][:, None] + dx - rx[t[rows]][:, None] * side, s)
            out.append((np.repeat(keys[:, rows], ok.sum(axis=1), axis=1), dx[ok], dy[ok], cost[ok]))
    if out:
        found = np.concatenate([o[0] for o in out], axis=1)
        rest = [np.concatenate([o[j] for o in out]) for j in (1, 2, 3)]
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*found, *rest], kinds, strict=True)], names=["video_id", "f", "x", "y", "size", "ref_f", "dx", "dy", "cost"])


def matched(blocks: DataFrame, refs: DataFrame, most: int, size: int, make, more: str) -> DataFrame:
    """Blocks (LEAF, ref_f, pos_x, pos_y, ...) with what ``make(block, match, size)`` adds to them, from their match in a reference tile.

    As in ``offset_costs``, a tile meets the list of the blocks that ask it;
    ``make`` takes many blocks of one size, their columns and matches (three
    planes, ``GONE`` where there is no pixel), and gives the columns ``more``.
    """
    at = {"rx": F.expr(f"CAST(pos_x div {size} AS INT)"), "ry": F.expr(f"CAST(pos_y div {size} AS INT)")}
    kept = [c for c in blocks.columns if c not in ("video_id", "ref_f")]
    kinds = ", ".join(f"{c} {t}" for c, t in blocks.select("video_id", "ref_f", *kept).dtypes)
    lists = blocks.withColumns(at).groupBy("video_id", "ref_f", "rx", "ry").agg(F.collect_list(F.struct(*kept)).alias("blocks"))
    both = lists.join(by_sort(refs), ["video_id", "ref_f", "rx", "ry"]).select("video_id", "ref_f", "rx", "ry", "blocks", "parts")
    names = ["video_id", "ref_f", *kept, *(m.split()[0] for m in more.split(", "))]
    return both.mapInArrow(partial(_matches, side=size, most=most, make=make, names=names), f"{kinds}, {more}").select(*blocks.columns, *names[2 + len(kept) :])


def _matches(batches: Iterator, side: int, most: int, make, names: list[str]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, SOME):
            part = batch.slice(start, SOME)
            planes, blocks = _wide_planes(part.column(5), side, most), part.column(4).flatten()
            t = np.repeat(np.arange(part.num_rows), part.column(4).value_lengths().to_numpy(zero_copy_only=False))
            rx, ry = (part.column(i).to_numpy(zero_copy_only=False)[t] for i in (2, 3))
            sizes, px, py = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("size", "pos_x", "pos_y"))
            for s in np.unique(sizes):
                rows = np.flatnonzero(sizes == s)
                block, match = dict(zip((f.name for f in blocks.type), blocks.take(pa.array(rows)).flatten(), strict=True)), []
                for plane, n in zip(planes, (1, 2, 2), strict=True):
                    views = np.lib.stride_tricks.sliding_window_view(plane, (s // n, s // n), axis=(1, 2))
                    match.append(views[t[rows], (py - ry * side)[rows] // n, (px - rx * side)[rows] // n].reshape(len(rows), -1))
                keys = [part.column(i).take(pa.array(t[rows])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *block.values(), *make(block, match, int(s))], names)


def squares(column, n: int):
    """Rows of ``n`` numbers of a column of arrays of that length, ``GONE`` in place of null."""
    return _plane(column, 1).reshape(len(column), n)


def place_costs(own: list, planes: list, t, y, x, size: int):
    """(possible, cost) of places (y, x) of blocks in the planes of their tiles or frames ``t``: a row a block, a column a place."""
    import numpy as np

    ok, cost = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
    for mine, there, n, weight in zip(own, planes, (1, 2, 2), (1, 4, 4), strict=True):
        b = size // n
        block = mine.reshape(-1, 1, b, b)
        views = np.lib.stride_tricks.sliding_window_view(there, (b, b), axis=(1, 2))
        at = views[t[:, None], y // n, x // n]
        has, d = block != GONE, block - at
        if (at == GONE).any() or not has.all():
            ok &= ~((at == GONE) & has).any(axis=(2, 3))
            d = np.where(has & (at != GONE), d, 0)
        # squares of thousandths don't fit 32 bits; their sums are whole below 2**53 as doubles
        d = d.reshape(*x.shape, -1).astype(np.float64)
        cost += weight * (np.einsum("ijk,ijk->ij", d, d).astype(np.int64) * (b * b) // np.maximum(1, has.sum(axis=(2, 3))))
    return ok, cost


def whole_frames(tiles: DataFrame, size: int = 32) -> DataFrame:
    """(video_id, ref_f, tiles): the tiles of a frame as one list."""
    if "rgb" in tiles.columns:
        rows = tiles.select("video_id", F.col("f").alias("ref_f"), F.struct("tx", "ty", "has", "rgb").alias("t"))
    else:
        kinds = ", ".join(f"{c} {t}" for c, t in tiles.select("video_id", F.col("f").alias("ref_f"), F.col("tx").alias("rx"), F.col("ty").alias("ry")).dtypes)
        sent = tiles.select(*TILE, "ym", "um", "vm").mapInArrow(partial(_plane_strips, most=2, size=size), f"{kinds}, kind int, planes binary").where("kind = 0")
        rows = sent.select("video_id", "ref_f", F.struct(F.col("rx").alias("tx"), F.col("ry").alias("ty"), "planes").alias("t"))
    return rows.groupBy("video_id", "ref_f").agg(F.collect_list("t").alias("tiles"))


def walked(asked: DataFrame, frames: DataFrame, rings: dict, window: int, size: int = 32) -> DataFrame:
    """The ends of the frontiers of blocks (``block``, ref_f) in whole reference frames, with the columns of ``offset_costs``."""
    lists = asked.groupBy("video_id", "ref_f").agg(F.collect_list("block").alias("blocks"))
    both = lists.join(by_sort(frames), ["video_id", "ref_f"]).select("video_id", "ref_f", "blocks", "tiles")
    return both.mapInArrow(partial(_walks, rings=rings, window=window, side=size), _COSTS)


def _walks(batches: Iterator, rings: dict, window: int, side: int) -> Iterator:
    """Frames of one shape go together, as many as have ``SOME`` tiles."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        first = np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))[:-1])
        shape = np.stack([np.maximum.reduceat(batch.column(3).flatten().field(c).to_numpy(zero_copy_only=False), first) + 1 for c in ("ty", "tx")], axis=1)
        shapes, kind = np.unique(shape, axis=0, return_inverse=True)
        for k, (h, w) in enumerate(shapes.tolist()):
            rows, many = np.flatnonzero(kind.reshape(-1) == k), max(1, SOME // (h * w))
            for at in range(0, len(rows), many):
                yield from _walk(batch.take(pa.array(rows[at : at + many])), h * side, w * side, rings, window, side)


def _walk(batch, height: int, width: int, rings: dict, window: int, side: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def owners(column):
        return np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))

    flat, t, blocks, owner = batch.column(3).flatten(), owners(batch.column(3)), batch.column(2).flatten(), owners(batch.column(2))
    if flat.type.get_field_index("rgb") >= 0:
        has = np.unpackbits(_bytes(flat.field("has"), -(-side * side // 8)), axis=1, count=side * side).view(bool)
        parts = [np.where(known, v, GONE) for v, known in planes_of(has, _bytes(flat.field("rgb"), 3 * side * side).reshape(-1, 3, side * side).swapaxes(0, 1), side)]
    else:
        parts = np.split(_thick(_bytes(flat.field("planes"), 6 * side * side)), [side * side, side * side * 5 // 4], axis=1)
    f, xs, ys, sizes = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("f", "x", "y", "size"))
    tx, ty = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
    pad, planes = int(sizes.max()), []  # a place whose corner is inside is whole
    for part, n in zip(parts, (1, 2, 2), strict=True):
        plane, b = np.full((batch.num_rows, (height + pad) // n, (width + pad) // n), GONE, np.int32), side // n
        plane[t[:, None, None], (ty * b)[:, None, None] + np.arange(b)[:, None], (tx * b)[:, None, None] + np.arange(b)] = part.reshape(-1, b, b)
        planes.append(plane)
    dx, dy, radius, cost = np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64), np.full(len(xs), 4), np.full(len(xs), -1)
    for s in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == s)
        own = [squares(blocks.field(c).take(pa.array(same)), (s // n) ** 2) for c, n in (("yb", 1), ("ub", 2), ("vb", 2))]
        while len(left := np.flatnonzero(radius[same] > 0)):
            for r, ring in rings.items():
                ring = np.array(sorted(ring, key=lambda o: (o[1], o[0])))  # the first of equal costs is the one of the least dy, then dx
                mine = left[radius[same[left]] == r]
                left, many = left[radius[same[left]] != r], max(1, 1_000_000 // (len(ring) * s * s))
                for some in (mine[i : i + many] for i in range(0, len(mine), many)):
                    k, each = same[some], np.arange(len(some))
                    cx, cy = dx[k][:, None] + ring[:, 0], dy[k][:, None] + ring[:, 1]
                    x, y = xs[k][:, None] + cx, ys[k][:, None] + cy
                    inside = (abs(cx) <= window) & (abs(cy) <= window) & (x >= 0) & (y >= 0) & (x < width) & (y < height)
                    ok, found = place_costs([o[some] for o in own], planes, owner[k], np.where(inside, y, 0), np.where(inside, x, 0), s)
                    found = np.where(ok & inside, found, np.iinfo(np.int64).max)
                    best = found.argmin(axis=1)
                    better = (ok & inside)[each, best] & ((cost[k] < 0) | (found[each, best] < cost[k]))
                    moved = better & ((cx[each, best] != dx[k]) | (cy[each, best] != dy[k]))
                    dx[k], dy[k], cost[k] = np.where(better, (cx[each, best], cy[each, best], found[each, best]), (dx[k], dy[k], cost[k]))
                    radius[k] = np.where((r > 1) & moved, r, r // 2)
    done = cost >= 0
    named = [batch.column(i).take(pa.array(owner[done])) for i in (0, 1)]
    cols = [named[0].cast(pa.int64()), *(pa.array(c[done], pa.int32()) for c in (f, xs, ys, sizes)), named[1].cast(pa.int32()), *(pa.array(c[done], pa.int32()) for c in (dx, dy)), pa.array(cost[done], pa.int64())]
    yield pa.RecordBatch.from_arrays(cols, ["video_id", "f", "x", "y", "size", "ref_f", "dx", "dy", "cost"])


def window_offsets(lo: int, hi: int):
    """All offsets of a square window as an array of (dx, dy)."""
    return F.expr(f"flatten(transform(sequence({lo}, {hi}), i -> transform(sequence({lo}, {hi}), j -> named_struct('dx', i, 'dy', j))))")
