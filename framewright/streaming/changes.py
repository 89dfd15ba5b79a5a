"""Frames as a stream: change detection against the previous frame, bounded history.

Both keep their state in RocksDB, which ``stream_query_settings`` switches on
for a session.  A frame's pixels come in one batch; frames numbered at or below
the last one seen come out as rows marked ``late`` and change no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import tiles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
BLOCK = 8


def stream_query_settings(spark: SparkSession) -> None:
    """State in RocksDB, which arbitrary state needs; states outgrow an executor's heap otherwise."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_frames(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = 1) -> DataFrame:
    """Pixel tables as they land; with ``per_trigger`` so many files a batch, else all there are."""
    source = spark.readStream.schema(schema)
    return (source if per_trigger is None else source.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def stream_images(spark: SparkSession, path: str, per_trigger: int | None = 1) -> DataFrame:
    """Image files as they land in ``video_id=*`` folders, with the columns of ``scan_frames``."""
    source = spark.readStream.format("image").schema(IMAGE).option("pathGlobFilter", "*.*")
    found = (source if per_trigger is None else source.option("maxFilesPerTrigger", per_trigger)).load(f"{path}/video_id=*")
    return found.select(
        F.regexp_extract("image.origin", r"video_id=(\d+)", 1).cast("long").alias("video_id"),
        F.regexp_extract("image.origin", r"(\d+)\.\w+$", 1).cast("int").alias("frame_no"),
        "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data",
    )


def _planes(has: np.ndarray, rgb: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Luma (tile x tile) and the two chroma planes (2 x half x half) of a tile in thousandths, -1 outside the frame."""
    (y, known), *chroma = tiles.planes_of(has[None], rgb[:, None], tile)
    half = tile // 2
    return np.where(known, y, -1).astype(np.int64).reshape(tile, tile), np.stack([np.where(inside, v, -1).astype(np.int64).reshape(half, half) for v, inside in chroma])


def _exceeds(now: np.ndarray, before: np.ndarray, limit: int, size: int) -> np.ndarray:
    """Blocks of ``size`` whose mean square change is above the limit; False where the frame before lacks a pixel."""
    inside = now >= 0
    square = np.where(inside, (now - before) ** 2, 0)
    n = now.shape[-1] // size
    of_blocks = lambda a: a.reshape(n, size, n, size).sum((1, 3))
    return (of_blocks(square) > limit * of_blocks(inside)) & (of_blocks(inside & (before < 0)) == 0)


class _Changes(StatefulProcessor):
    """State of a tile: number and planes of its last frame, as bytes of 32-bit numbers."""

    def __init__(self, tile: int) -> None:
        self.tile = tile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "f int, luma binary, chroma binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        video, tx, ty = key
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in rows:
            for f, bits, packed in zip(part.f, part.has, part.rgb, strict=True):
                has = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.tile * self.tile).view(bool)
                rgb = np.frombuffer(packed, np.uint8).reshape(3, -1)
                if f in got:
                    has, rgb = got[f][0] | has, np.where(has, rgb, got[f][1])
                got[f] = has, rgb
        half, n, out, before = self.tile // 2, self.tile // BLOCK, [], None
        last = -1
        if self.last.exists():
            last, luma, chroma = self.last.get()
            before = np.frombuffer(luma, np.int32).reshape(self.tile, self.tile), np.frombuffer(chroma, np.int32).reshape(2, half, half)
        began = last
        for f, frame in sorted(got.items()):
            if f <= began:
                out.append((video, int(f), tx * n, ty * n, True))
                continue
            now = _planes(*frame, self.tile)
            if before is not None:
                changed = _exceeds(now[0], before[0], 1_550_000, BLOCK)
                for plane in (0, 1):
                    changed |= _exceeds(now[1][plane], before[1][plane], 3_600_000, BLOCK // 2)
                out += [(video, int(f), int(tx * n + i), int(ty * n + j), False) for j, i in zip(*np.nonzero(changed), strict=True)]
            last, before = int(f), now
        if last != began:
            self.last.update((last, *(p.astype(np.int32).tobytes() for p in before)))
        yield pd.DataFrame(out, columns=["video_id", "f", "bx", "by", "late"])

    def close(self) -> None:
        pass


def stream_changed_blocks(pixels: DataFrame, tile: int = 32) -> DataFrame:
    """Changed 8x8 blocks (video_id, f, bx, by, late) against the previous frame seen.

    State is kept by tile.  A late frame gives one row a tile, ``late`` being
    true, at the tile's first block.  Tasks pack what they read of a tile
    into one row a batch, so that the state's shuffle has few rows.
    """
    return tiles.packed(pixels, tile, lines=False).groupBy("video_id", "tx", "ty").transformWithStateInPandas(
        _Changes(tile), "video_id long, f int, bx int, by int, late boolean", "Append", "None"
    )


class _History(StatefulProcessor):
    """State of a video: the list of its last frames' numbers."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "f int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        last, out = past[-1] if past else -1, []
        for f in sorted({int(f) for part in rows for f in part.f.unique()}):
            if f <= last:
                out.append((key[0], f, [], True))
                continue
            out.append((key[0], f, list(past), False))
            past = (past + [f])[-self.keep :]
        self.past.put([(f,) for f in past])
        yield pd.DataFrame(out, columns=["video_id", "f", "history", "late"])

    def close(self) -> None:
        pass


def stream_history(frames: DataFrame, keep: int = 4) -> DataFrame:
    """For each new frame the up to ``keep`` frames before it: (video_id, f, history, late); late ones have no history."""
    return frames.select("video_id", "f").groupBy("video_id").transformWithStateInPandas(
        _History(keep), "video_id long, f int, history array<int>, late boolean", "Append", "None"
    )
