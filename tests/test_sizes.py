"""Tables that grow with the input are never sent whole through the driver."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from framewright.operators import motion, tiles, transform
from framewright.queries import Q
from framewright.sources import fixtures, frames
from framewright.sources.shared import cut

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["resize_mod4", "assemble_raster", "yuv_to_rgb", "frame_delta", "overlay", "edge_neighbours", "reconstruct", "reconstruct_one", "deblock_columns", "deblock_rows", "deblock_both",
                                  "frame_stats", "encode_open_loop", "encode_pattern", "pattern_search", "motion_search", "part_index", "packing_ratio", "changed_per_frame", "encode_residuals"])
def test_no_growing_table_is_broadcast(spark, name):
    plan = Q[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_pixels_join_where_they_are(spark):
    """The resize needs no shuffle of pixels beyond the dealing of frames."""
    px = fixtures.pixels(spark, SMALL).where("x < 30 AND y < 31")
    plan = frames.resize_to_multiple(px)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "tx" in line]


def test_resize_of_a_frame_with_holes(spark):
    """A target stays while any of its four neighbours is there, and weights of the missing ones are left out."""
    px = spark.createDataFrame([(1, 0, x, y, x * 10, y, 7) for x in range(7) for y in range(6) if (x, y) != (0, 0) and not (x < 3 and y > 3)], "video_id long, f int, x int, y int, r int, g int, b int")
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in frames.resize_to_multiple(px).collect()}
    have = {(r.x, r.y): (r.r, r.g, r.b) for r in px.collect()}
    expected = {}
    for tx in range(4):
        for ty in range(4):
            s = [max(0, min((2 * t + 1) * full * 512 // 4 - 512, (full - 1) * 1024)) for t, full in ((tx, 7), (ty, 6))]
            near = [(min(s[0] // 1024 + i, 6), min(s[1] // 1024 + j, 5), (s[0] % 1024 if i else 1024 - s[0] % 1024) * (s[1] % 1024 if j else 1024 - s[1] % 1024)) for i in (0, 1) for j in (0, 1)]
            near = [(have[x, y], w) for x, y, w in near if (x, y) in have]
            if near:
                expected[tx, ty] = tuple((sum(w * c[k] for c, w in near) + 524288) // 1048576 for k in range(3))
    assert got == expected


def test_blocks_carry_their_own_pixels(spark):
    """``changed_blocks`` are the changed leaves with the pixels that ``block_arrays`` takes from the tiles, one video lacking a tile in a frame."""
    px = fixtures.pixels(spark, SMALL).where("NOT (video_id = 3 AND f = 2)").where("NOT (video_id = 4 AND f = 1 AND x >= 16)")
    t = cut(tiles.with_leaves(tiles.frame_tiles(px, 16), 16))
    cols = [*tiles.LEAF, "yb", "ub", "vb"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    leaves, own = cut(tiles.changed_leaves(t, size=16)), tiles.changed_blocks(t, size=16)
    assert leaves.where("video_id = 4 AND f = 2 AND x >= 16").count() == 0  # the frame before lacks the tile, an older one has it
    assert leaves.where("video_id = 3 AND f = 3").count() > 0
    assert rows(own) == rows(tiles.block_arrays(leaves, t, 16))


def test_levels_of_every_size(spark):
    """Levels by numpy are those of the transform's joins with small tables."""
    rng = np.random.default_rng(5)
    rows = [(1, 1, 0, 0, s, *(rng.integers(-90_000, 90_000, n).tolist() for n in (s * s, s * s // 4, s * s // 4))) for s in (4, 8, 16)]
    df = spark.createDataFrame(rows, "video_id long, f int, x int, y int, size int, dy array<bigint>, du array<bigint>, dv array<bigint>")
    got = {(r["size"], r["chan"], r["sub"], r.v, r.u): r.level for r in transform.levels(transform.code_blocks(df)).collect()}
    for s, m in ((8, 8), (16, 8), (4, 4)):
        d = next(r for r in rows if r[4] == s)[5]
        n = s // m
        samples = [(p // n * n + p % n, x, y, d[(p % n * m + y) * s + p // n * m + x] / 1000.0) for p in range(n * n) for x in range(m) for y in range(m)]
        coefs = transform.dct2d(spark.createDataFrame(samples, "tile int, x int, y int, val double"), ["tile"], m)
        for r in transform.quantize(coefs, "Y", m).collect():
            assert got[s, "Y", r.tile, r.v, r.u] == r.level


def test_leaves_of_a_tile_that_leaves_the_frame():
    """A tile with pixels in 6 of its 16 columns splits down to fours along the border."""
    x, y = np.meshgrid(np.arange(16), np.arange(16))
    plane = pa.array([[int(v) if c < 6 else None for v, c in zip((x * 3 + y).ravel(), x.ravel(), strict=True)]], pa.list_(pa.int32()))
    got = tiles._leaf_lists(np.array([1]), np.array([0]), [plane] * 3, 16, 45, 4).to_pylist()[0]
    assert sorted({(leaf["x"], leaf["size"]) for leaf in got}) == [(16, 4), (20, 4)] and len(got) == 8
    first = next(leaf for leaf in got if (leaf["x"], leaf["y"]) == (16, 0))
    assert first["r"] == int(sum(i * 3 + j for i in range(4) for j in range(4)) // 16)


def test_tiles_put_together_from_parts(spark):
    """Tiles of pixels in any order, with holes, in many batches and tasks; no list of pixels is collected."""
    rng = np.random.default_rng(3)
    rows = [(v, f, x, y, *(int(c) for c in rng.integers(0, 256, 3))) for v in (1, 2) for f in range(2) for x in range(37) for y in range(21) if (v, f, x % 5, y) != (2, 1, 3, 7)]
    rng.shuffle(rows)
    px = spark.createDataFrame([tuple(map(int, r)) for r in rows], "video_id long, f int, x int, y int, r int, g int, b int").repartition(5)
    want = {}
    for v, f, x, y, *colours in rows:
        want.setdefault((v, f, x // 16, y // 16), {})[y % 16 * 16 + x % 16] = tuple(map(int, colours))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = tiles.frame_tiles(px, 16)
        assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(t.video_id, t.f, t.tx, t.ty): t for t in found.collect()}
        leaves = sorted(tuple(r) for r in tiles.leaf_rows(px, 16).collect())
        planes = {(t.video_id, t.f, t.tx, t.ty): t for t in tiles.leafy_tiles(px, 16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() == planes.keys()
    for key, pixels in want.items():
        t = got[key]
        assert {i: (r, g, b) for i, (r, g, b) in enumerate(zip(t.r, t.g, t.b, strict=True)) if r is not None} == pixels
        assert [t.ym[i] for i in pixels] == [299 * r + 587 * g + 114 * b for r, g, b in pixels.values()]
        assert all((planes[key].ym, planes[key].um, planes[key].vm)[k] == (t.ym, t.um, t.vm)[k] for k in range(3))
    assert leaves == sorted(tuple(r) for r in tiles.with_leaves(tiles.frame_tiles(px, 16), 16).select("video_id", "f", F.inline("leaves")).collect())


def test_packed_tiles_give_what_their_planes_give(spark):
    """Changes and costs of frames of many tiles, some lacking pixels or a tile, in small batches."""
    px = fixtures.pixels(spark, SMALL).where("video_id IN (2, 3, 5, 7) AND x < 29 AND y < 27")
    px = px.where("NOT (video_id = 3 AND f = 2)").where("NOT (video_id = 5 AND f = 1 AND x >= 16)").where("NOT (video_id = 7 AND f = 3 AND x > 13 AND x < 19)")
    t = cut(tiles.leafy_tiles(px, 16))
    plain = t.drop("has", "rgb")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    refs = motion.reference_pairs(px)
    want, costs = rows(tiles.changed_blocks(plain, size=16)), rows(motion.match_cost(tiles.changed_blocks(plain, size=16), refs, plain, most=16, size=16))
    sums = rows(tiles.block_change(plain, size=16))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        packed = tiles.changed_blocks(t, size=16)
        assert rows(packed) == want and want
        assert rows(tiles.block_change(t, size=16)) == sums
        assert rows(motion.match_cost(packed, refs, t, most=16, size=16)) == costs and costs
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_shuffles_no_planes(spark):
    """What goes to the tile before and to the references is the packed tile, not its planes."""
    t = cut(tiles.leafy_tiles(fixtures.pixels(spark, SMALL)))
    for found in (tiles.changed_blocks(t), tiles.references(t, 32)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "rgb" in plan and "ym" not in plan
