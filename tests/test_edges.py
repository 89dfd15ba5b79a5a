from pyspark.sql import functions as F

from framewright.operators import planes, tiles, transform
from framewright.plans import codec
from framewright.sources import fixtures

from .test_reference import SF, cut, rows  # noqa: F401


def test_the_last_four_pixels_are_coded(spark, cut):  # noqa: F811
    """12x12 frames in blocks of 8: those at the border are coded by their pixels inside it."""
    small = fixtures.pixels(spark, SF).where("video_id = 1 AND f <= 1 AND x < 12 AND y < 12").persist()
    vectors, coded, stats = codec.encode(small, block=8, cut=cut)
    at = {(r.x, r.y) for r in coded.select("x", "y").collect()}
    assert {(8, 0), (0, 8), (8, 8)} <= at and vectors.count() == len(at)
    assert stats.agg(F.sum("n_uncoded")).first()[0] == 0 and transform.levels(coded).count() == 96 * len(at)
    luma, chroma = tiles.to_planes(codec.decode(small.where("f = 0"), coded, cut))
    assert luma.where("f = 1").count() == 144 and chroma.where("f = 1").count() == 36
    both = luma.where("f = 1 AND (x >= 8 OR y >= 8)").withColumnRenamed("ym", "got").join(planes.luma(small), ["video_id", "f", "x", "y"])
    before = planes.luma(small).where("f = 0").select("x", "y", F.col("ym").alias("y0"))
    n, worst, stale = both.join(before, ["x", "y"]).agg(F.count("*"), F.avg(F.abs(F.col("got") - F.col("ym"))), F.avg(F.abs(F.col("y0") - F.col("ym")))).first()
    assert n == 80 and worst < stale / 2


def test_tiles_of_frames_that_do_not_fill_them(spark):
    """34x33 frames in tiles of 16: planes equal those of the rows of pixels, leaves cover each pixel once."""
    px = spark.range(34 * 33).selectExpr("7L AS video_id", "0 AS f", "CAST(id % 34 AS INT) AS x", "CAST(id div 34 AS INT) AS y", "CAST(id * 7 % 256 AS INT) AS r", "CAST(id * 13 % 256 AS INT) AS g", "CAST(id % 5 AS INT) AS b")
    t = tiles.frame_tiles(px, 16).persist()
    luma, chroma = tiles.to_planes(t, 16)
    assert rows(luma, "x", "y", "ym") == rows(planes.luma(px), "x", "y", "ym")
    assert rows(chroma, "cx", "cy", "um", "vm") == rows(planes.chroma(px), "cx", "cy", "um", "vm")
    covered = tiles.leaf_pixels(tiles.with_leaves(t, 16), 16)
    assert rows(covered, "x", "y") == rows(px, "x", "y")
    again = tiles.with_luma(t, luma, 16)
    assert rows(again.select("tx", "ty", F.hash("ym").alias("h")), "tx", "ty", "h") == rows(t.select("tx", "ty", F.hash("ym").alias("h")), "tx", "ty", "h")
