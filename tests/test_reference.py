import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framewright import oracle
from framewright.functions import scalars as fn
from framewright.operators import blocks, motion, planes, rebuild, records, tiles, transform
from framewright.plans import codec
from framewright.sources import fixtures, frames

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def px(spark):
    return fixtures.pixels(spark, SF).where("video_id < 3").persist()


@pytest.fixture
def cut(tmp_path):
    made = []

    def write(df):
        made.append(str(tmp_path / f"t{len(made)}"))
        df.write.parquet(made[-1])
        return df.sparkSession.read.schema(df.schema).parquet(made[-1])

    return write


def rows(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()))


@pytest.mark.parametrize("name", ["changed_blocks", "changed_leaves", "motion_search", "pattern_search", "encode_pattern", "quadtree_leaves", "mosaic", "pack_parts", "unpack_parts", "leaf_residuals", "encode_residuals", "reconstruct_one", "deblock_columns", "frame_gaps", "frame_stats"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("supplier", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name]).fetchdf()
    keys = sorted(got.columns)
    assert keys == sorted(want.columns)
    assert rows(got, *keys) == sorted(want[keys].itertuples(index=False, name=None))


def test_every_sql_has_a_query():
    assert set(oracle.ORACLE_SQL) <= set(entry.queries())


def test_positions_come_back(spark):
    given = [0, 4, 8, 12, 16, 28, 32, 75, 4096, 65000, 733]
    df = spark.createDataFrame([(p,) for p in given], "pos int").withColumn("back", fn.from_big_endian(fn.big_endian(F.col("pos"), 2)))
    assert all(r.pos == r.back for r in df.collect())


def test_rounding_goes_up_at_halves(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,)], "x double").select(fn.java_round(F.col("x")))
    assert [r[0] for r in df.collect()] == [-2, 3]


def test_leaves_tile_the_frame(px):
    areas = blocks.quadtree(px).groupBy("video_id", "f").agg(F.sum(F.col("size") * F.col("size")).alias("a"))
    assert {r.a for r in areas.collect()} == {1024}


def test_transform_and_back(spark):
    t = fixtures.tiles(spark, SF).where("tile < 5")
    back = transform.idct2d(transform.dct2d(t, ["tile"], 8), ["tile"], 8).withColumnRenamed("val", "again")
    assert t.join(back, ["tile", "x", "y"]).where("abs(val - again) > 1e-4").count() == 0
    four = blocks.split_subtiles(t, 4)
    assert rows(blocks.merge_subtiles(four, 4), "tile", "x", "y", "val") == rows(t, "tile", "x", "y", "val")


@pytest.fixture(scope="session")
def encoded(px):
    vectors, coded, stats = codec.encode(px)
    return vectors, coded.persist(), stats


def test_pack_and_unpack(encoded):
    vectors, coded, _ = encoded
    got = records.unpack_parts(records.pack_parts(coded))
    assert {r.size for r in got.select("size").distinct().collect()} >= {4, 8, 16}
    cols = ["video_id", "f", "pos_x", "pos_y", "span_x", "span_y", "ref", "size"]
    assert rows(got, *cols) == rows(vectors, *cols)
    wrap = lambda df: rows(df.selectExpr("video_id", "f", "x", "y", *[f"transform({c}, l -> sign(l) * (abs(l) & 127)) AS {c}" for c in ("ly", "lu", "lv")]), "video_id", "f", "x", "y", "ly", "lu", "lv")
    assert wrap(got) == wrap(coded)


@pytest.mark.parametrize("payload", ["0100", "01000000000000120000", "01000000000000FF"])
def test_broken_payloads_are_refused(spark, payload):
    part = spark.createDataFrame([(1, 0, bytearray.fromhex(payload))], "video_id long, f int, payload binary")
    with pytest.raises(Exception, match="no record at byte 1"):
        records.unpack_parts(part).collect()


def test_levels_past_seven_bits_wrap(spark):
    one = spark.createDataFrame([(1, 1, 0, 4, 8, 8, 0, 0, 8, 8, 4, 0, [130, -130] + [0] * 14, [0] * 4, [0] * 4)], "video_id long, f int, ref_f int, ref int, pos_x int, pos_y int, span_x int, span_y int, x int, y int, size int, cost long, ly array<int>, lu array<int>, lv array<int>")
    assert records.unpack_parts(records.pack_parts(one)).first().ly[:2] == [2, -2]
    assert transform.record_overflow(one).first()[2:] == (24, 2, 2, 0)


def test_static_videos_have_no_vectors(px, cut):
    assert codec.encode(px.where("video_id = 0"), cut=cut)[0].count() == 0
    one = codec.encode(px.where("f = 0"), cut=cut)  # a video of one frame
    assert one[0].count() == one[1].count() == one[2].count() == 0


def kernel_levels(d, m, quant):
    k = np.arange(m)
    w = np.sqrt(np.where(k[:, None] == 0, 1, 2) / m) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / (2 * m))
    return np.floor(np.round(w @ (d.T / 1000 - 128) @ w.T, 6) / np.array(quant) + 0.5).astype(int)  # rows of d are y


def test_levels_and_back_equal_a_numpy_kernel(px, encoded, cut):
    vectors, _, _ = encoded
    d = transform.residual_blocks(vectors, cut(tiles.frame_tiles(px))).persist()
    got = {(r.video_id, r.f, r.x, r.y): r for r in transform.code_blocks(d).collect()}
    back = {(r.video_id, r.f, r.x, r.y): r for r in transform.decode_blocks(transform.code_blocks(d)).collect()}
    for r in d.collect():
        for a, name, chan, half in ((r.dy, "y", "Y", 1), (r.du, "u", "C", 2), (r.dv, "v", "C", 2)):
            side, m = r.size // half, (8 if chan == "Y" else 4) // (2 if r.size == 4 else 1)
            block, want, lost = np.array(a, float).reshape(side, side), [], []
            for i in range(0, side, m):
                for j in range(0, side, m):
                    want += kernel_levels(block[j : j + m, i : i + m], m, transform.QUANT[chan, m]).ravel().tolist()
            assert list(got[r.video_id, r.f, r.x, r.y]["l" + name]) == want
            lost = np.abs(np.array(back[r.video_id, r.f, r.x, r.y]["d" + name]) - np.array(a))
            assert lost.max() <= 1000 * sum(map(sum, transform.QUANT[chan, m])) / m  # half a step of each level, at most


def test_search_equals_a_numpy_kernel(px, encoded):
    frame = {}
    for r in px.selectExpr("video_id", "f", "x", "y", "299 * r + 587 * g + 114 * b AS ym").collect():
        frame.setdefault((r.video_id, r.f), np.zeros((32, 32), np.int64))[r.y, r.x] = r.ym
    cells = {}
    for r in planes.chroma(px).collect():
        cells.setdefault((r.video_id, r.f), np.zeros((2, 16, 16), np.int64))[:, r.cy, r.cx] = r.um, r.vm
    for v in encoded[0].collect():
        x, y, s, best = v.pos_x + v.span_x, v.pos_y + v.span_y, v.size, []
        for ref in range(max(0, v.f - 4), v.f):
            for dx in range(-2, 2):
                for dy in range(-2, 2):
                    if 0 <= x + dx <= 32 - s and 0 <= y + dy <= 32 - s:
                        a = frame[v.video_id, v.f][y : y + s, x : x + s] - frame[v.video_id, ref][y + dy : y + dy + s, x + dx : x + dx + s]
                        h, cx, cy = s // 2, (x + dx) // 2, (y + dy) // 2
                        c = cells[v.video_id, v.f][:, y // 2 : y // 2 + h, x // 2 : x // 2 + h] - cells[v.video_id, ref][:, cy : cy + h, cx : cx + h]
                        best.append(((a * a).sum() + 4 * (c * c).sum(), ref, dy, dx))
        assert min(best) == (v.cost, v.ref_f, -v.span_y, -v.span_x)


def test_equal_references_take_the_older_one(spark, px, cut):
    """Frames 0 and 1 are alike, frame 2 shows the object moved."""
    two = px.where("video_id = 1 AND f IN (0, 3)").selectExpr("video_id", "CASE WHEN f = 3 THEN 2 ELSE 0 END AS f", "x", "y", "r", "g", "b")
    three = two.unionByName(two.where("f = 0").withColumn("f", F.lit(1)))
    found = codec.encode(three, cut=cut)[0]
    assert {(r.f, r.ref_f, r.ref) for r in found.select("f", "ref_f", "ref").distinct().collect()} == {(2, 0, 4)}


def test_frontier_never_costs_more_than_staying(px, cut):
    t = cut(tiles.with_leaves(tiles.frame_tiles(px)))
    changed = cut(tiles.changed_leaves(t).where("f <= 2"))
    refs = motion.reference_pairs(px)
    cols = ["video_id", "f", "x", "y", "size", "ref_f"]
    found = motion.pattern_search(changed, t, cut, window=48).persist()
    stay = motion.match_cost(changed, refs, t, 0, 0).withColumnRenamed("cost", "c0")
    both = stay.drop("dx", "dy").join(found, cols)
    assert both.count() == changed.join(refs, ["video_id", "f"]).count() == found.count() and both.where("cost > c0").count() == 0
    whole = motion.match_cost(changed, refs, t, -31, 31).groupBy(*cols).agg(F.min("cost").alias("least"))
    assert found.join(whole, cols).where("cost < least").count() == 0
    both = motion.combined_search(changed, t, cut, window=4)
    small = motion.motion_search(changed, t)
    at = lambda df, c: motion.targets(df).select("video_id", "f", "x", "y", F.col("cost").alias(c))
    assert at(both, "a").join(at(small, "b"), ["video_id", "f", "x", "y"]).where("a > b").count() == 0


def test_closed_loop_is_what_decode_rebuilds(px, cut):
    small = px.where("video_id IN (1, 2) AND f <= 2")
    vectors, coded, stats, rebuilt = codec.encode_closed_loop(small, cut, smooth=False)
    again = codec.decode(small.where("f = 0"), coded, cut)
    cols = ["video_id", "f", "tx", "ty", "ym", "um", "vm"]
    assert rows(again, *cols) == rows(rebuilt, *cols) and again.count() == 6
    # the first step has source frames as references in both kinds of encode
    cols = ["video_id", "f", "ref_f", "pos_x", "pos_y", "span_x", "span_y", "size", "cost"]
    assert rows(vectors.where("f = 1"), *cols) == rows(codec.encode(small, cut=cut)[0].where("f = 1"), *cols)
    # rebuilt frames lie nearer to the source than the frame before does
    luma = tiles.to_planes(rebuilt)[0].withColumnRenamed("ym", "got").join(planes.luma(small), ["video_id", "f", "x", "y"])
    before = planes.luma(small).selectExpr("video_id", "f + 1 AS f", "x", "y", "ym AS y0")
    near, far = luma.join(before, ["video_id", "f", "x", "y"]).agg(F.avg(F.abs(F.col("got") - F.col("ym"))), F.avg(F.abs(F.col("y0") - F.col("ym")))).first()
    assert near < far / 2 and stats.count() == 4


def test_smoothing_a_step(spark):
    luma = spark.createDataFrame([(1, 0, x, y, (60 if x < 8 else 70) * 1000) for x in range(16) for y in range(16)], "video_id long, f int, x int, y int, ym long")
    vectors = spark.createDataFrame([(1, 0, 8, 8, 0, 0, 8)], "video_id long, f int, pos_x int, pos_y int, span_x int, span_y int, size int")
    got = {(r.x, r.y): r.ym for r in rebuild.deblock(luma, vectors).collect()}
    # p0 and q0 move by ((70 - 60) * 4 + (60 - 70) + 4) >> 3 = 4; the outer ones by (60 + 65 - 120) >> 1 = 2 and (70 + 65 - 140) >> 1 = -3
    assert [got[x, 12] // 1000 for x in range(5, 11)] == [60, 62, 64, 66, 67, 70]
    assert [got[x, 3] // 1000 for x in range(5, 11)] == [60, 60, 60, 70, 70, 70]


def test_scan_bitmaps(spark, tmp_path):
    for n in (1, 2, 4):
        folder = tmp_path / "video_id=7"
        folder.mkdir(exist_ok=True)
        data = np.full((2, 4, 3), n, np.uint8).tobytes()
        (folder / f"{n:04d}.bmp").write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(data), 0, 0, 54, 40, 4, 2, 1, 24, 0, len(data), 0, 0, 0, 0) + data)
    found = frames.scan_frames(spark, str(tmp_path))
    assert rows(found, "video_id", "frame_no", "width", "height") == [(7, n, 4, 2) for n in (1, 2, 4)]
    got = frames.explode_pixels(found)
    assert got.count() == 24 and rows(frames.frame_gaps(got), "video_id", "f") == [(7, 3)]
    frames.write_table(got, str(tmp_path / "out"))
    assert frames.read_table(spark, str(tmp_path / "out")).count() == 24


@pytest.mark.parametrize(("channels", "data", "want"), [(1, [7, 9], [(7, 7, 7), (9, 9, 9)]), (3, [30, 20, 10, 3, 2, 1], [(10, 20, 30), (1, 2, 3)]), (4, [30, 20, 10, 200, 3, 2, 1, 0], [(10, 20, 30), (1, 2, 3)])])
def test_pixels_of_grey_and_transparent_images(spark, channels, data, want):
    image = spark.createDataFrame([(1, 0, 2, 1, channels, bytearray(data))], "video_id long, frame_no int, width int, height int, n_channels int, data binary")
    assert rows(frames.explode_pixels(image), "x", "r", "g", "b") == [(x, *c) for x, c in enumerate(want)]
