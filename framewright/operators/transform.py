"""Cosine transform, quantisation and their inverses as joins with small constant tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import by_sort
from . import tiles as arrays
from .motion import targets

# Quantisation steps by table, rows v, columns u.
QUANT = {
    ("Y", 8): ((16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
               (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99)),
    ("Y", 4): ((8, 12, 24, 32), (5, 14, 25, 34), (16, 23, 24, 43), (21, 24, 26, 48)),
    ("C", 4): ((8, 12, 20, 44), (12, 14, 23, 46), (27, 25, 39, 48), (44, 44, 48, 48)),
    ("C", 2): ((4, 48), (48, 48)),
}


def basis(spark: SparkSession, m: int) -> DataFrame:
    """(k, i, w): weight of sample i in coefficient k of a transform of size m."""
    step = lambda k: 1 / math.sqrt(m) if k == 0 else math.sqrt(2.0 / m)
    rows = [(k, i, step(k) * math.cos((2 * i + 1) * k * math.pi / (2 * m))) for k in range(m) for i in range(m)]
    return F.broadcast(spark.createDataFrame(rows, "k int, i int, w double"))  # m * m rows


def quant_table(spark: SparkSession, plane: str, m: int) -> DataFrame:
    rows = [(v, u, q) for v, row in enumerate(QUANT[plane, m]) for u, q in enumerate(row)]
    return F.broadcast(spark.createDataFrame(rows, "v int, u int, q int"))  # m * m rows


def _two_steps(df: DataFrame, keys: list[str], first: tuple, second: tuple, value) -> DataFrame:
    """Transform rows, then columns: two grouped sums of m products instead of one of m * m."""
    w = basis(df.sparkSession, first[3])
    (a, to_a, side_a, _), (b, to_b, side_b, _) = first, second
    df = df.repartition(*keys).withColumn("_s", value)
    for at, to, side, other in ((a, to_a, side_a, b), (b, to_b, side_b, to_a)):
        new = "k" if side == "i" else "i"
        df = df.join(w.withColumnsRenamed({side: at, new: to}), at).groupBy(*keys, other, to).agg(F.sum(F.col("_s") * F.col("w")).alias("_s"))
    return df


def dct2d(samples: DataFrame, keys: list[str], m: int, value: str = "val") -> DataFrame:
    """(keys, v, u, coef) from (keys, x, y, value); 128 is taken off first."""
    out = _two_steps(samples, keys, ("x", "v", "i", m), ("y", "u", "i", m), F.col(value) - 128.0)
    return out.select(*keys, "v", "u", F.round("_s", 6).alias("coef"))


def idct2d(coefs: DataFrame, keys: list[str], m: int, value: str = "coef") -> DataFrame:
    """(keys, x, y, val) from (keys, v, u, value); 128 is put back."""
    out = _two_steps(coefs, keys, ("v", "x", "k", m), ("u", "y", "k", m), F.col(value).cast("double"))
    return out.select(*keys, "x", "y", (F.round("_s", 6) + 128).alias("val"))


def quantize(coefs: DataFrame, plane: str, m: int) -> DataFrame:
    table = quant_table(coefs.sparkSession, plane, m)
    return coefs.join(table, ["v", "u"]).withColumn("level", F.floor(F.col("coef") / F.col("q") + 0.5).cast("int")).drop("q", "coef")


def dequantize(levels: DataFrame, plane: str, m: int) -> DataFrame:
    table = quant_table(levels.sparkSession, plane, m)
    return levels.join(table, ["v", "u"]).withColumn("coef", F.col("level") * F.col("q")).drop("q", "level")


def dead_zone(d, most: int):
    return F.when(F.abs(d) > most, d).otherwise(F.lit(0).cast("long"))


def residual_blocks(vectors: DataFrame, tiles: DataFrame, most: int = 32, size: int = 32, own: DataFrame | None = None, matches: bool = False) -> DataFrame:
    """Vectors with their blocks' differences ``dy``, ``du``, ``dv`` to the match, row by row, in thousandths.

    Small differences are 0 (``dead_zone``), and so are places outside the frame.
    ``own`` has the blocks with their pixels, if they are known (``tiles.changed_blocks``).
    With ``matches`` the match itself comes too, as ``yp``, ``up``, ``vp``.
    """
    more = ", yp array<int>, up array<int>, vp array<int>" if matches else ""
    return _met(vectors, tiles, most, size, own, partial(_differences, matches=matches), "dy array<bigint>, du array<bigint>, dv array<bigint>" + more)


def rebuilt_matches(vectors: DataFrame, tiles: DataFrame, most: int = 32, size: int = 32, own: DataFrame | None = None) -> DataFrame:
    """Vectors with their blocks rebuilt: ``yb``, ``ub``, ``vb`` are the match plus the differences of ``residual_blocks``, null outside the frame."""
    return _met(vectors, tiles, most, size, own, _sums, "yb array<int>, ub array<int>, vb array<int>")


def _met(vectors: DataFrame, tiles: DataFrame, most: int, size: int, own: DataFrame | None, make, more: str) -> DataFrame:
    """Vectors with what ``make`` finds from their blocks' pixels and their match's."""
    v = targets(vectors)
    own = arrays.block_arrays(v.select(*arrays.LEAF), tiles, size) if own is None else own
    own = own.select(*arrays.LEAF, F.col("yb").alias("oy"), F.col("ub").alias("ou"), F.col("vb").alias("ov"))
    both = v.join(by_sort(own), list(arrays.LEAF)).select(*v.columns, "oy", "ou", "ov")
    return arrays.matched(both, arrays.references(tiles, most, size), most, size, make, more).drop("oy", "ou", "ov")


def _zoned(block: dict, match: list, size: int):
    """(match, difference, known) of each plane; small differences are 0."""
    import numpy as np

    for name, there, n, zone in (("oy", match[0], 1, 1000), ("ou", match[1], 2, 2000), ("ov", match[2], 2, 2000)):
        own = arrays.squares(block[name], (size // n) ** 2)
        known = (own != arrays.GONE) & (there != arrays.GONE)
        d = np.where(known, own - there, 0)
        yield there, np.where(abs(d) > zone, d, 0), known


def _differences(block: dict, match: list, size: int, matches: bool) -> list:
    import numpy as np

    found = [arrays.listed(d.astype(np.int64)) for _, d, _ in _zoned(block, match, size)]
    return found + [arrays._listed(there, there != arrays.GONE) for there in match] if matches else found


def _sums(block: dict, match: list, size: int) -> list:
    return [arrays._listed(there + d, known) for there, d, known in _zoned(block, match, size)]


def _long(df: DataFrame, keys: tuple, arrays_of: dict[str, str]):
    """One row per value of some arrays: keys, chan, place in the array, value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("chan"), F.col(a).alias("a")) for k, a in arrays_of.items()]))
    return df.select(*keys, each.alias("e")).select(*keys, "e.chan", F.posexplode("e.a").alias("i", "a"))


def residuals(blocks: DataFrame) -> DataFrame:
    """(video_id, f, x, y, size, chan, i, j, d): differences of ``residual_blocks`` with places inside the block."""
    rows = _long(blocks, arrays.LEAF, {"Y": "dy", "U": "du", "V": "dv"})
    wide = "CASE WHEN chan = 'Y' THEN size ELSE size div 2 END"
    return rows.selectExpr(*arrays.LEAF, "chan", f"CAST(i % {wide} AS INT) AS i", f"CAST(i div {wide} AS INT) AS j", "a AS d")


def code_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with levels ``ly``, ``lu``, ``lv`` in record order: 8x8 luma and 4x4 chroma parts, 4x4 and 2x2 for blocks of 4.

    Parts go by columns, levels in a part by v, then u.
    """
    kept = [c for c in blocks.columns if c not in ("dy", "du", "dv")]
    kinds = ", ".join(f"{c} {t}" for c, t in blocks.select(*kept).dtypes)
    return blocks.select(*kept, "dy", "du", "dv").mapInArrow(partial(_coded, n=len(kept), size=kept.index("size")), f"{kinds}, ly array<int>, lu array<int>, lv array<int>")


def _coded(batches: Iterator, n: int, size: int) -> Iterator:
    import numpy as np

    def levels(d: np.ndarray, chan: str, m: int, side: int) -> np.ndarray:
        """Quantised levels of squares of one size; sums are added up in the order of their samples."""
        step = lambda k: 1 / math.sqrt(m) if k == 0 else math.sqrt(2.0 / m)
        weight = [[step(k) * math.cos((2 * i + 1) * k * math.pi / (2 * m)) for i in range(m)] for k in range(m)]
        parts = d.reshape(-1, side // m, m, side // m, m).transpose(0, 3, 1, 2, 4) / 1000.0 - 128.0  # block, column of parts, row of parts, y, x
        dot = lambda a: np.stack([sum((w * a[..., i] for i, w in enumerate(row)), np.zeros(a.shape[:-1])) for row in weight], axis=-1)
        coefs = dot(dot(parts).swapaxes(-1, -2))  # over x to v, then over y to u
        return np.floor(np.round(coefs, 6) / np.array(QUANT[chan, m]) + 0.5).astype(np.int32).reshape(len(d), -1)

    return _by_size(batches, n, size, levels, ("ly", "lu", "lv"))


def decode_blocks(coded: DataFrame) -> DataFrame:
    """Vectors with differences ``dy``, ``du``, ``dv`` in thousandths, row by row, back from levels in record order."""
    kept = [c for c in coded.columns if c not in ("ly", "lu", "lv")]
    kinds = ", ".join(f"{c} {t}" for c, t in coded.select(*kept).dtypes)
    return coded.select(*kept, "ly", "lu", "lv").mapInArrow(partial(_decoded, n=len(kept), size=kept.index("size")), f"{kinds}, dy array<bigint>, du array<bigint>, dv array<bigint>")


def _decoded(batches: Iterator, n: int, size: int) -> Iterator:
    import numpy as np

    def samples(found: np.ndarray, chan: str, m: int, side: int) -> np.ndarray:
        step = lambda k: 1 / math.sqrt(m) if k == 0 else math.sqrt(2.0 / m)
        weight = [[step(k) * math.cos((2 * i + 1) * k * math.pi / (2 * m)) for k in range(m)] for i in range(m)]
        dot = lambda a: np.stack([sum((w * a[..., k] for k, w in enumerate(row)), np.zeros(a.shape[:-1])) for row in weight], axis=-1)
        parts = found.reshape(-1, side // m, side // m, m, m).astype(np.int64) * np.array(QUANT[chan, m])  # block, column of parts, row of parts, v, u
        cells = np.round(dot(dot(parts).swapaxes(-1, -2)), 6)  # over u to y, then over v to x
        return np.floor((cells + 128) * 1000 + 0.5).astype(np.int64).transpose(0, 2, 3, 1, 4).reshape(len(found), -1)

    return _by_size(batches, n, size, samples, ("dy", "du", "dv"))


def rebuilt_coded(coded: DataFrame) -> DataFrame:
    """Blocks (LEAF, yb, ub, vb): the matches ``yp``, ``up``, ``vp`` plus the differences decoded from the levels."""
    found = decode_blocks(coded.select(*arrays.LEAF, "yp", "up", "vp", "ly", "lu", "lv"))
    kinds = ", ".join(f"{c} {t}" for c, t in found.select(*arrays.LEAF).dtypes)
    return found.mapInArrow(_added, f"{kinds}, yb array<int>, ub array<int>, vb array<int>")


def _added(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        *keys, yp, up, vp, dy, du, dv = batch.columns
        lists = []
        for p, d in ((yp, dy), (up, du), (vp, dv)):
            ends = np.append(0, np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pc.add(p.flatten(), d.flatten()).cast(pa.int32())))
        yield pa.RecordBatch.from_arrays([*keys, *lists], [*arrays.LEAF, "yb", "ub", "vb"])


def _by_size(batches: Iterator, n: int, size: int, change, names: tuple) -> Iterator:
    """Batches with their three last columns changed by ``change(arrays, table, part, side)``, blocks of one size at a time."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sides = batch.column(size).to_numpy()
        for s in np.unique(sides):
            rows = np.flatnonzero(sides == s)
            some = batch.take(pa.array(rows))
            lists = []
            for k, (chan, m, side) in enumerate((("Y", 8, s), ("C", 4, s // 2), ("C", 4, s // 2))):
                d = some.column(n + k).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), side * side)
                found = change(d, chan, m // 2 if s == 4 else m, int(side))
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, side * side, dtype=np.int32)), pa.array(found.ravel())))
            yield pa.RecordBatch.from_arrays([*some.columns[:n], *lists], [*batch.schema.names[:n], *names])


def levels(coded: DataFrame) -> DataFrame:
    """(video_id, f, x, y, size, sub, chan, v, u, level): one row a level."""
    rows = _long(coded, arrays.LEAF, {"Y": "ly", "U": "lu", "V": "lv"})
    m = "(CASE WHEN chan = 'Y' THEN 8 ELSE 4 END div CASE WHEN size = 4 THEN 2 ELSE 1 END)"
    return rows.selectExpr(*arrays.LEAF, f"CAST(i div ({m} * {m}) AS INT) AS sub", "chan", f"CAST(i % ({m} * {m}) div {m} AS INT) AS v", f"CAST(i % {m} AS INT) AS u", "a AS level")


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("chan", "level").agg(F.count("*").alias("n"))


def level_overflow(levels: DataFrame) -> DataFrame:
    """Levels per channel that seven bits can't hold."""
    return levels.groupBy("chan").agg(F.count("*").alias("n"), F.sum(F.when(F.abs("level") > 127, 1).otherwise(0)).alias("n_overflow"))


def zero_share(levels: DataFrame) -> DataFrame:
    """Levels per channel, those that are 0, and their share in millionths."""
    zeros = F.sum(F.when(F.col("level") == 0, 1).otherwise(0))
    got = levels.groupBy("chan").agg(F.count("*").alias("n"), zeros.cast("long").alias("n_zero"))
    return got.withColumn("zero_micro", F.expr("n_zero * 1000000 div n").cast("long"))


def record_overflow(coded: DataFrame) -> DataFrame:
    """Per frame: levels and spans, and how many of them seven bits can't hold."""
    levels = "concat(ly, lu, lv)"
    wide = F.expr(f"size(filter({levels}, l -> abs(l) > 127))")
    spans = F.expr("CASE WHEN abs(span_x) > 127 THEN 1 ELSE 0 END + CASE WHEN abs(span_y) > 127 THEN 1 ELSE 0 END")
    long = lambda c, name: F.sum(c).cast("long").alias(name)
    return coded.groupBy("video_id", "f").agg(long(F.expr(f"size({levels})"), "n_levels"), long(wide, "n_wide_levels"), (2 * F.count("*")).alias("n_spans"), long(spans, "n_wide_spans"))
