import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import tiles
from framewright.sources import fixtures, frames
from framewright.streaming import changes, sink

from .test_reference import SF, rows

BLOCKS = ["video_id", "f", "bx", "by"]


@pytest.fixture(scope="module")
def small(spark):
    changes.stream_query_settings(spark)
    return fixtures.pixels(spark, SF).where("video_id IN (1, 2)").persist()


@pytest.fixture(scope="module")
def batch(small):
    t = tiles.grid(tiles.frame_tiles(small))
    return rows(tiles.changed_leaves(t).selectExpr("video_id", "f", "CAST(x div 8 AS INT) AS bx", "CAST(y div 8 AS INT) AS by"), *BLOCKS)


def land(small, where, path):
    small.where(where).coalesce(1).write.mode("append").parquet(str(path))


def run(df, path, name="out"):
    q = sink.stream_sink(df, str(path / name), str(path / f"{name}-state"))
    assert q.awaitTermination(120)


def test_restarted_stream_equals_batch_and_shows_late_frames(spark, small, batch, tmp_path):
    def step():
        pixels = changes.stream_frames(spark, str(tmp_path / "in"), small.schema)
        run(changes.stream_changed_blocks(pixels), tmp_path)

    for f in (0, 1, 2):
        land(small, f"f = {f}", tmp_path / "in")
    step()
    land(small, "f IN (3, 4)", tmp_path / "in")  # two frames in one batch
    land(small, "f = 5", tmp_path / "in")
    step()  # goes on from the state of the first run
    got = sink.read_committed(spark, str(tmp_path / "out"), spark.createDataFrame([], "video_id long, f int, bx int, by int, late boolean").schema)
    assert rows(got.where("NOT late"), *BLOCKS) == batch and got.where("late").count() == 0
    land(small, "f = 2 AND video_id = 2", tmp_path / "in")
    step()
    assert rows(got.sparkSession.read.schema(got.schema).parquet(str(tmp_path / "out" / "data" / "*")).where("late"), *BLOCKS) == [(2, 2, 0, 0)]


def test_history_keeps_four_and_shows_late_frames(spark, small, tmp_path):
    for f in (0, 2, 3, 4, 5, 1):
        land(small, f"f = {f} AND video_id = 1", tmp_path / "in")
    run(changes.stream_history(changes.stream_frames(spark, str(tmp_path / "in"), small.schema)), tmp_path)
    schema = spark.createDataFrame([], "video_id long, f int, history array<int>, late boolean").schema
    got = {r.f: (r.history, r.late) for r in sink.read_committed(spark, str(tmp_path / "out"), schema).collect()}
    assert got == {0: ([], False), 2: ([0], False), 3: ([0, 2], False), 4: ([0, 2, 3], False), 5: ([0, 2, 3, 4], False), 1: ([], True)}


def test_stop_between_write_and_commit(spark, small, batch, tmp_path, monkeypatch):
    """The batch that was written but not committed is not seen, and is there once after a restart."""
    for f in range(6):
        land(small, f"f = {f}", tmp_path / "in")
    commit, out = sink.commit, str(tmp_path / "out")

    def stops(spark, path, batch_id, folder):
        if batch_id == 3:
            raise RuntimeError("stopped here")
        commit(spark, path, batch_id, folder)

    flow = lambda: changes.stream_changed_blocks(changes.stream_frames(spark, str(tmp_path / "in"), small.schema))
    schema = spark.createDataFrame([], "video_id long, f int, bx int, by int, late boolean").schema
    assert sink.read_committed(spark, out, schema).count() == 0
    monkeypatch.setattr(sink, "commit", stops)
    with pytest.raises(Exception, match="stopped here"):
        run(flow(), tmp_path)
    assert rows(sink.read_committed(spark, out, schema), *BLOCKS) == [r for r in batch if r[1] < 3]
    monkeypatch.setattr(sink, "commit", commit)
    run(flow(), tmp_path)
    assert rows(sink.read_committed(spark, out, schema), *BLOCKS) == batch
    assert sink.drop_uncommitted(spark, out) == 1 and sink.drop_uncommitted(spark, out) == 0
    assert rows(sink.read_committed(spark, out, schema), *BLOCKS) == batch


def test_a_committed_batch_is_left_alone(spark, small, tmp_path, monkeypatch):
    """Stopped after the commit and before the checkpoint: the repeated batch adds nothing."""
    land(small, "f = 0", tmp_path / "in")
    commit, out = sink.commit, str(tmp_path / "out")

    def commits_and_stops(*given):
        commit(*given)
        raise RuntimeError("stopped here")

    flow = lambda: changes.stream_frames(spark, str(tmp_path / "in"), small.schema)
    monkeypatch.setattr(sink, "commit", commits_and_stops)
    with pytest.raises(Exception, match="stopped here"):
        run(flow(), tmp_path)
    monkeypatch.setattr(sink, "commit", commit)
    run(flow(), tmp_path)
    assert sink.read_committed(spark, out, small.schema).count() == 2048


def bitmap(path, rgb):
    """A 24-bit file, rows from the bottom up."""
    h, w, _ = rgb.shape
    data = rgb[::-1, :, ::-1].tobytes()
    path.write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(data), 0, 0, 54, 40, w, h, 1, 24, 0, len(data), 0, 0, 0, 0) + data)


def test_images_landing_one_by_one_equal_the_batch(spark, small, batch, tmp_path):
    (tmp_path / "in" / "video_id=1").mkdir(parents=True)
    for f in range(6):
        rgb = np.zeros((32, 32, 3), np.uint8)
        for r in small.where(f"video_id = 1 AND f = {f}").collect():
            rgb[r.y, r.x] = r.r, r.g, r.b
        bitmap(tmp_path / "in" / "video_id=1" / f"{f:04d}.bmp", rgb)
        pixels = frames.explode_pixels(changes.stream_images(spark, str(tmp_path / "in")))
        run(changes.stream_changed_blocks(pixels), tmp_path)
    schema = spark.createDataFrame([], "video_id long, f int, bx int, by int, late boolean").schema
    got = sink.read_committed(spark, str(tmp_path / "out"), schema)
    assert rows(got, *BLOCKS) == [r for r in batch if r[0] == 1]
    whole = frames.explode_pixels(frames.scan_frames(spark, str(tmp_path / "in")))
    cols = ["f", "x", "y", "r", "g", "b"]
    assert rows(whole, *cols) == rows(small.where("video_id = 1"), *cols)


def test_rewriting_one_video_leaves_the_others(spark, small, tmp_path):
    path = str(tmp_path / "t")
    frames.write_table(small, path)
    kept = sorted(p.name for p in (tmp_path / "t" / "video_id=1").iterdir())
    frames.write_table(small.where("video_id = 2 AND f = 0").withColumn("r", F.lit(7)), path, whole=False)
    assert sorted(p.name for p in (tmp_path / "t" / "video_id=1").iterdir()) == kept
    got = frames.read_table(spark, path)
    assert got.where("video_id = 1").count() == small.where("video_id = 1").count()
    assert got.where("video_id = 2").select("f", "r").distinct().collect() == [(0, 7)]
    one = got.where("video_id = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert {r.at.split("/")[-2] for r in one.select(F.input_file_name().alias("at")).distinct().collect()} == {"video_id=2"}
    assert "PartitionFilters: [isnotnull(video_id" in plan


def test_stream_state_gets_tiles_not_pixels(spark, small, batch, tmp_path):
    """Tasks pack what they read of a tile; a frame that lands in pieces, of several files and batches of rows, is put together."""
    for k in range(3):
        small.where(f"(x + 2 * y) % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = changes.stream_changed_blocks(changes.stream_frames(spark, str(tmp_path / "in"), small.schema, None))
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "has" in plan and "rgb" in plan
        run(found, tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(sink.read_committed(spark, str(tmp_path / "out"), found.schema).where("NOT late"), *BLOCKS) == batch
