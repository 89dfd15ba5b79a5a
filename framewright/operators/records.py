"""Frames of vector records packed into bytes and back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


HEADER = 7


def pack_parts(coded: DataFrame) -> DataFrame:
    """(video_id, f, payload): 0x01, then per block a 7-byte header and its Y, U and V levels; blocks by columns.

    ``coded`` has vectors with levels (``transform.code_blocks``), of any sizes.
    """
    head = F.concat(
        fn.big_endian(F.col("pos_x"), 2), fn.big_endian(F.col("pos_y"), 2), fn.big_endian(fn.signmag7(F.col("span_x")), 1),
        fn.big_endian(fn.signmag7(F.col("span_y")), 1), fn.big_endian(fn.refsize(F.col("ref"), F.col("size")), 1),
    )
    keys = coded.select("video_id", "f", "x", "y", head.alias("head"), F.concat("ly", "lu", "lv").alias("l"))
    kinds = ", ".join(f"{c} {t}" for c, t in keys.dtypes[:5])
    rows = keys.mapInArrow(_level_codes, f"{kinds}, codes binary").select("video_id", "f", "x", "y", F.concat("head", F.hex("codes")).alias("h"))
    parts = rows.groupBy("video_id", "f").agg(F.array_sort(F.collect_list(F.struct("x", "y", "h"))).alias("r"))
    return parts.select("video_id", "f", F.unhex(F.concat(F.lit("01"), F.array_join("r.h", ""))).alias("payload"))


def _level_codes(batches: Iterator) -> Iterator:
    """Levels as bytes of sign and magnitude (``scalars.signmag7``)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(5)
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        code = (abs(v) & 127 | np.where(v < 0, 128, 0)).astype(np.uint8)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        codes = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(code)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], codes], ["video_id", "f", "x", "y", "head", "codes"])


def record_bytes(parts: DataFrame) -> DataFrame:
    """(video_id, f, no, record): payloads cut into their records.

    A record's length follows from its seventh byte, so a cursor goes from one
    to the next; the lengths of all places are computed first, at once.  Bytes
    that don't make a whole record raise an error.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        size = np.zeros(16, np.int64)
        for pixels, code in fn.SIZE_CODES.items():
            size[code] = pixels
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for video, frame, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = payload or b"\x01"
                side = size[np.frombuffer(payload, np.uint8) & 15]
                length, at, no = np.where(side > 0, HEADER + side * side * 3 // 2, 0), 1, 0
                while at < len(payload):
                    n = int(length[at + 6]) if at + 6 < len(payload) else 0
                    if not n or at + n > len(payload):
                        raise ValueError(f"video {video}, frame {frame}: no record at byte {at}")
                    for col, v in zip(rows, (video, frame, no, payload[at : at + n]), strict=True):
                        col.append(v)
                    at, no = at + n, no + 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["video_id", "f", "no", "record"])

    return parts.select(F.col("video_id").cast("long"), F.col("f").cast("int"), "payload").mapInArrow(run, "video_id long, f int, no int, record binary")


def unpack_parts(parts: DataFrame) -> DataFrame:
    """Vectors with levels ``ly``, ``lu``, ``lv`` back from payloads; no offsets are needed."""
    rec = record_bytes(parts).withColumn("h", F.hex("record"))
    num = lambda a, n: F.conv(F.substring("h", a * 2 + 1, n * 2), 16, 10).cast("int")
    ref, size = fn.from_refsize(num(6, 1))
    v = rec.select("video_id", "f", "h", num(0, 2).alias("pos_x"), num(2, 2).alias("pos_y"), fn.from_signmag7(num(4, 1)).alias("span_x"), fn.from_signmag7(num(5, 1)).alias("span_y"), ref.alias("ref"), size.alias("size"))
    codes = F.expr(f"transform(sequence({HEADER}, {HEADER} + size * size * 3 div 2 - 1), i -> CAST(conv(substring(h, CAST(2 * i + 1 AS INT), 2), 16, 10) AS INT))")
    v = v.withColumns({"x": F.col("pos_x") + F.col("span_x"), "y": F.col("pos_y") + F.col("span_y"), "codes": codes})
    v = v.withColumn("codes", F.transform("codes", fn.from_signmag7))
    cuts = {"ly": "slice(codes, 1, size * size)", "lu": "slice(codes, size * size + 1, CAST(size * size div 4 AS INT))", "lv": "slice(codes, CAST(size * size * 5 div 4 + 1 AS INT), CAST(size * size div 4 AS INT))"}
    return v.select(*[c for c in v.columns if c not in ("h", "codes")], *[F.expr(e).alias(c) for c, e in cuts.items()])


def part_index(parts: DataFrame) -> DataFrame:
    """Length and absolute offset of every part: 12 bytes of header, a count, the lengths, then the parts in order."""
    w = Window.partitionBy("video_id").orderBy("part_no")
    whole = Window.partitionBy("video_id")
    ahead = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("video_id", "part_no", "len", (F.lit(16) + 4 * F.count("*").over(whole) + ahead).cast("long").alias("byte_offset"))
