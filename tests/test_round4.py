"""Queries that left out part of their work, and rebuilding by tiles against rows of pixels."""

import re
import time

import pytest
from pyspark.sql import functions as F

from framewright.operators import motion, planes, rebuild, tiles, transform
from framewright.plans import codec
from framewright.queries import Q
from framewright.sources import fixtures, frames
from framewright.sources.shared import CLEANUP, cut

SMALL = "/root/testdata/sf0.001"


def rows(df, *keys):
    return sorted(map(tuple, df.select(*(keys or sorted(df.columns))).collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Frames of several tiles of 16 that don't fill them; a frame, a tile and some pixels are missing."""
    px = fixtures.pixels(spark, SMALL).where("video_id IN (2, 3, 5, 7) AND x < 29 AND y < 27")
    px = px.where("NOT (video_id = 3 AND f = 2)").where("NOT (video_id = 5 AND f = 1 AND x >= 16)").where("NOT (video_id = 7 AND f = 3 AND x > 13 AND x < 19)")
    t = cut(tiles.leafy_tiles(px, 16))
    changed = cut(tiles.changed_blocks(t, size=16))
    return px, t, changed, cut(motion.motion_search(changed, t, most=16, size=16))


def test_pattern_search_leaves_the_neighbourhood(spark):
    """The window is the search's own, 48 pixels, not four."""
    far = Q["pattern_search"](spark, SMALL).where("abs(dx) > 4 OR abs(dy) > 4")
    assert far.count() > 100


def test_reconstruct_has_chroma(spark):
    """Two chroma planes of a quarter of the luma's places each."""
    n = {r.chan: r["count"] for r in Q["reconstruct"](spark, SMALL).groupBy("chan").count().collect()}
    assert n.keys() == {"Y", "U", "V"} and n["Y"] == 4 * n["U"] == 4 * n["V"] > 0


def test_rebuilt_blocks_are_their_match_and_differences(odd):
    px, t, changed, vectors = odd
    vectors = vectors.where("video_id <> 7")  # a cell that lacks its first pixel has chroma in rows of pixels only
    got = rebuild.reconstruct(transform.rebuilt_matches(vectors, t, 16, 16, changed))
    v = motion.targets(vectors).select(*tiles.LEAF, "ref_f", "pos_x", "pos_y")
    d = transform.residuals(transform.residual_blocks(vectors, t, 16, 16, changed)).join(v, list(tiles.LEAF))
    planes_ = planes.luma(px).selectExpr("video_id", "f", "'Y' AS chan", "x", "y", "ym AS value")
    c = planes.chroma(px)
    for chan, name in (("U", "um"), ("V", "vm")):
        planes_ = planes_.unionByName(c.selectExpr("video_id", "f", f"'{chan}' AS chan", "cx AS x", "cy AS y", f"{name} AS value"))
    n = "CASE WHEN chan = 'Y' THEN 1 ELSE 2 END"
    at = d.selectExpr("video_id", "f", "ref_f", "chan", f"CAST(x div {n} + i AS INT) AS x", f"CAST(y div {n} + j AS INT) AS y", f"CAST(pos_x div {n} + i AS INT) AS mx", f"CAST(pos_y div {n} + j AS INT) AS my", "d")
    at = at.join(planes_.selectExpr("video_id", "f", "chan", "x", "y", "value AS own"), ["video_id", "f", "chan", "x", "y"])
    there = planes_.selectExpr("video_id", "f AS ref_f", "chan", "x AS mx", "y AS my", "value AS was")
    want = at.join(there, ["video_id", "ref_f", "chan", "mx", "my"]).selectExpr("video_id", "f", "chan", "x", "y", "CAST(was + d AS BIGINT) AS value")
    assert rows(got) == rows(want) and want.count() > 1000


def test_a_step_of_decoding_by_tiles(odd):
    """The frame before with the blocks over it, as an overlay of rows of pixels has it."""
    px, t, changed, vectors = odd
    blocks = cut(transform.rebuilt_matches(vectors, t, 16, 16, changed))
    index = frames.frame_index(px)
    got = rebuild.reconstruct_step(t, blocks, index, 16)
    before = planes.luma(px).withColumnRenamed("f", "prev_f")
    base = index.where("prev_f IS NOT NULL").join(before, ["video_id", "prev_f"]).select("video_id", "f", "x", "y", "ym")
    patch = rebuild.reconstruct(blocks).where("chan = 'Y'").withColumnRenamed("value", "ym")
    assert rows(got) == rows(rebuild.overlay(base, patch)) and got.count() > 1000


@pytest.mark.parametrize("packed", [True, False])
def test_smoothing_by_tiles(odd, packed):
    """Edges on and near the borders of tiles read and change the neighbours' pixels, as in rows of pixels."""
    px, t, _, vectors = odd
    given = t if packed else t.drop("has", "rgb")
    luma = planes.luma(px)
    for passes, want in (("x", rebuild.deblock_pass(luma, vectors, False)), ("y", rebuild.deblock_pass(luma, vectors, True)), ("xy", rebuild.deblock(cut(luma), vectors))):
        got = rebuild.smoothed(given, vectors, passes, 16)
        found = rows(tiles.luma_rows(got, 16))
        assert found == rows(want) and found != rows(luma)
    assert packed or rows(got, "video_id", "f", "tx", "ty", "um", "vm") == rows(t, "video_id", "f", "tx", "ty", "um", "vm")


@pytest.mark.parametrize("name", ["reconstruct", "reconstruct_one", "deblock_columns", "deblock_rows", "deblock_both"])
def test_rebuilding_joins_no_rows_of_pixels(spark, name):
    plan = Q[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.findall(r"SortMergeJoin \[video_id#\d+L?, \w+#\d+, x#\d+, y#\d+\]", plan)


@pytest.mark.parametrize("smooth", [True, False])
def test_both_loops_by_tiles(odd, smooth):
    """What the closed loop rebuilds, in frames of several tiles with parts missing, is what decode rebuilds from its records."""
    px, *_ = odd
    some = px.where("video_id IN (2, 3) AND f <= 3")
    _, coded, _, made = codec.encode_closed_loop(some, smooth=smooth, root=16)
    again = codec.decode(some, coded, smooth=smooth, root=16)
    assert rows(again, *tiles.TILE, "ym", "um", "vm") == rows(made, *tiles.TILE, "ym", "um", "vm") and made.count() == 7 * 4


def test_a_step_works_on_tiles(odd):
    """Blocks are matched, laid over tiles and smoothed by numpy on tiles, not by expressions over single samples or rows of pixels."""
    _, t, changed, vectors = odd
    plain = cut(t.select(*tiles.TILE, "ym", "um", "vm"))
    coded = cut(transform.code_blocks(transform.residual_blocks(vectors, plain, 16, 16, changed)))
    index = frames.frame_index(t)
    blocks = rebuild.rebuilt_blocks(transform.decode_blocks(coded), plain, 16, 16)
    step = codec._step(plain.where("f = 0"), index.where("f = 1"), blocks, 16)
    for made in (step, rebuild.smoothed(cut(step), vectors, size=16)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "zip_with" not in plan and "transform(" not in plan and "posexplode" not in plan


def test_frontiers_walk_over_tiles(odd):
    """In frames of several tiles the walk's ends have the costs that the window search has there, in packed tiles and in planes, and no round is a job."""
    px, t, changed, _ = odd
    written = []

    def count(df):
        written.append(df)
        return cut(df)

    found = motion.pattern_search(changed, t, count, window=6, most=16, size=16)
    assert len(written) == 1
    plain = motion.pattern_search(changed, t.drop("has", "rgb"), count, window=6, most=16, size=16)
    assert rows(found) == rows(plain)
    refs = motion.reference_pairs(px)
    costs = motion.match_cost(changed, refs, t, -6, 6, 16, 16)
    assert rows(found) == rows(found.drop("cost").join(costs, list(motion.CANDIDATE))) and found.where("abs(dx) > 4 OR abs(dy) > 4").count() > 10
    stay = costs.where("dx = 0 AND dy = 0").selectExpr(*motion.PLACE, "cost AS c0")
    assert found.join(stay, list(motion.PLACE)).where("cost > c0").count() == 0
    assert found.select(*motion.PLACE).distinct().count() == found.count() == costs.select(*motion.PLACE).distinct().count()


def test_a_written_table_leaves_no_shuffle(spark):
    """Shuffle files go when the table is there, not when the driver collects its memory; the session's setting stays."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before, given = shuffles(), spark.conf.get(CLEANUP, None)
    got = cut(spark.range(100_000).repartition(8, "id"))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before
    assert got.count() == 100_000 and spark.conf.get(CLEANUP, None) == given
