"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import blocks, motion, planes, rebuild, records, stats, tiles, transform
from .plans import codec
from .sources import fixtures, frames
from .sources.shared import by_sort, cut, own_folder
from .streaming import changes, sink

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[DataFrame], DataFrame]):
    """Register a query over the pixel fixture under the function's name."""
    Q[build.__name__] = lambda spark, sf_dir: build(fixtures.pixels(spark, sf_dir))
    return build


def tile_query(build: Callable[[DataFrame], DataFrame]):
    Q[build.__name__] = lambda spark, sf_dir: build(fixtures.tiles(spark, sf_dir))
    return build


# sources


@query
def frame_gaps(px):
    return frames.frame_gaps(px.where("f <> 2 OR video_id % 3 <> 0"))


@query
def resize_mod4(px):
    return frames.resize_to_multiple(px.where("x < 30 AND y < 31"), 4)


@query
def video_catalog(px):
    return frames.video_catalog(px)


@query
def start_frame_bytes(px):
    return frames.start_frame(px)


@query
def explode_packed(px):
    packed = px.groupBy("video_id", "f").agg(F.array_sort(F.collect_list(F.struct("y", "x", fn.pack_argb(F.col("r"), F.col("g"), F.col("b")).alias("c")))).alias("p"))
    return frames.explode_packed(packed.select("video_id", "f", F.lit(32).alias("width"), F.col("p.c").alias("argb")))


@query
def frame_index(px):
    return frames.frame_index(px)


@query
def part_index(px):
    vectors, _, _ = codec.encode(px)
    sizes = stats.payload_bytes(vectors)
    parts = frames.frame_index(px).where("n > 0").join(by_sort(sizes), ["video_id", "f"], "left").selectExpr("video_id", "n AS part_no", "coalesce(bytes, 1L) AS len")
    first = px.groupBy("video_id").agg(F.expr("CAST(count(DISTINCT x) * count(DISTINCT y) * 3 AS BIGINT) AS len")).selectExpr("video_id", "0 AS part_no", "len")
    return records.part_index(parts.unionByName(first))


@query
def pack_parts(px):
    packed = records.pack_parts(codec.encode(px)[1])
    return packed.select("video_id", "f", F.hex("payload").alias("payload"))


@query
def unpack_parts(px):
    """Every vector and a sum over its levels, back from payloads alone."""
    got = records.unpack_parts(records.pack_parts(codec.encode(px)[1]))
    total = "CAST(aggregate(transform(concat(ly, lu, lv), (l, i) -> l * (i + 1)), 0L, (t, l) -> t + l) AS BIGINT) AS level_sum"
    return got.selectExpr("video_id", "f", "x", "y", "size", "pos_x", "pos_y", "span_x", "span_y", "ref", total)


@query
def packing_ratio(px):
    return stats.packing_ratio(codec.encode(px)[0], px)


@query
def assemble_raster(px):
    return planes.assemble_raster(planes.luma(px), planes.chroma(px)).select("video_id", "f", F.array_join(F.col("argb").cast("array<string>"), ",").alias("argb"))


# functions


@query
def rgb_pack(px):
    p = px.withColumn("argb", fn.pack_argb(F.col("r"), F.col("g"), F.col("b")))
    return p.select("video_id", "f", "x", "y", "argb", *fn.unpack_rgb(F.col("argb")))


@query
def rgb_to_yuv(px):
    u, v = fn.chroma_micro(F.col("r"), F.col("g"), F.col("b"))
    return px.select("video_id", "f", "x", "y", fn.luma_milli(F.col("r"), F.col("g"), F.col("b")).alias("ym"), u.cast("long").alias("u_micro"), v.cast("long").alias("v_micro"))


@query
def yuv_to_rgb(px):
    return planes.to_rgb(planes.with_chroma(planes.luma(px), planes.chroma(px)))


@query
def position_codec(px):
    p = px.selectExpr("video_id", "f", "x", "y", "(video_id * 37 + f * 1009 + x * 61 + y) % 65536 AS pos").withColumn("code", fn.big_endian(F.col("pos"), 2))
    return p.withColumn("back", fn.from_big_endian(F.col("code")))


@query
def int32_codec(px):
    p = px.selectExpr("video_id", "f", "x", "y", "(video_id * 1000003 + f * 65537 + x * 4099 + y) % 2147483648 AS num").withColumn("code", fn.big_endian(F.col("num"), 4))
    return p.withColumn("back", fn.from_big_endian(F.col("code")))


@query
def signmag_codec(px):
    p = px.selectExpr("video_id", "f", "x", "y", "CAST(r - g AS INT) AS level").withColumn("code", fn.signmag7(F.col("level")))
    return p.withColumn("back", fn.from_signmag7(F.col("code")))


@query
def refsize_codec(px):
    p = px.selectExpr("video_id", "f", "x", "y", "1 + x % 4 AS ref", "CAST(shiftleft(4, y % 6) AS INT) AS size").withColumn("code", fn.refsize(F.col("ref"), F.col("size")))
    ref, size = fn.from_refsize(F.col("code"))
    return p.withColumns({"back_ref": ref, "back_size": size, "bytes": fn.record_size(F.col("size"))})


@query
def quadkey_order(px):
    leaves = cut(blocks.quadtree(px).select("video_id", "f", "x", "y", "size"))  # a sort reads its input twice
    return leaves.select("*", fn.quadkey(F.col("x"), F.col("y"), F.col("size"), 32, 32).alias("quadkey")).orderBy("video_id", "f", "quadkey")


# planes, blocks


@query
def chroma_subsample(px):
    return planes.chroma(px)


@query
def cell_means(px):
    return blocks.cell_means(px)


@query
def block_means(px):
    cells = blocks.cell_means(px)
    return blocks.block_means(cells, 8).unionByName(blocks.block_means(cells, 16)).unionByName(blocks.block_means(cells, 32))


@query
def block_stddev(px):
    return blocks.block_stddev(px, 8)


@query
def quadtree_leaves(px):
    return blocks.quadtree(px)


@query
def mosaic(px):
    return blocks.mosaic(px)


def _grid(px):
    """Tiles cut into 8x8 blocks, written once."""
    return cut(tiles.grid(tiles.frame_tiles(px)).drop("r", "g", "b"))


def _by_eight(df):
    """Block numbers in place of pixels."""
    at = [F.expr(f"CAST({c} div 8 AS INT) AS b{c}") for c in "xy"]
    return df.select("video_id", "f", *at, *[c for c in df.columns if c not in ("video_id", "f", "x", "y", "size")])


@query
def changed_leaves(px):
    """Leaves of the partition, of any size, that differ from the frame before."""
    return tiles.changed_leaves(cut(tiles.leafy_tiles(px)))


@query
def block_mse(px):
    return _by_eight(tiles.block_change(_grid(px)))


@query
def changed_blocks(px):
    return _by_eight(tiles.changed_leaves(_grid(px)))


@query
def frame_delta(px):
    return blocks.frame_delta(planes.luma(px))


@query
def tile_blocks(px):
    t = blocks.tile_blocks(planes.luma(px.where("x < 30")), 8, 30, 32)
    return t.select("video_id", "f", "bx", "by", F.array_join(F.col("plane").cast("array<string>"), ",").alias("plane"), "oob_count")


# motion


def _search(px):
    t = _grid(px)
    return t, cut(tiles.changed_blocks(t)), motion.reference_pairs(t)


def _costs(px):
    t, changed, refs = _search(px)
    return motion.match_cost(changed, refs, t, most=8)


def _vectors(px):
    t, changed, _ = _search(px)
    return t, changed, motion.motion_search(changed, t, most=8)


def _packed_vectors(px):
    """As ``_vectors``, of tiles written without their planes."""
    t = cut(tiles.grid(tiles.frame_tiles(px)).select(*tiles.TILE, "has", "rgb", "leaves"))
    changed = cut(tiles.changed_blocks(t))
    return t, changed, cut(motion.motion_search(changed, t, most=8))


@query
def reference_pairs(px):
    return motion.reference_pairs(px)


@query
def search_candidates(px):
    t, changed, refs = _search(px)
    return _by_eight(motion.candidates(changed, refs, motion.frame_ends(t)))


@query
def match_cost(px):
    return _by_eight(_costs(px))


@query
def best_match(px):
    return _by_eight(motion.best_match(_costs(px)))


@query
def top_k_matches(px):
    return _by_eight(motion.top_k_matches(_costs(px), 3))


@query
def motion_search(px):
    return _vectors(px)[2]


@query
def pattern_search(px):
    """The frontier of hexagons from every changed leaf, with the search's whole window."""
    t = cut(tiles.leafy_tiles(px, planes=False))
    return motion.pattern_search(cut(tiles.changed_blocks(t)), t, cut)


@query
def uncoded_blocks(px):
    _, changed, vectors = _vectors(px)
    return _by_eight(motion.uncoded_blocks(changed, vectors.where("cost < 64000000")))


@query
def match_offsets(px):
    return stats.match_offsets(codec.encode(px)[0])


# transform


@tile_query
def dct8(t):
    return transform.dct2d(t, ["tile"], 8)


@tile_query
def dct4(t):
    return transform.dct2d(blocks.split_subtiles(t, 4), ["tile", "sub"], 4)


@tile_query
def dct2(t):
    return transform.dct2d(blocks.split_subtiles(t, 2), ["tile", "sub"], 2)


@tile_query
def split_subtiles(t):
    return blocks.split_subtiles(t, 4)


@tile_query
def quantize(t):
    return transform.quantize(transform.dct2d(t, ["tile"], 8), "Y", 8).select("tile", "v", "u", "level")


@tile_query
def dequantize(t):
    q = transform.quantize(transform.dct2d(t, ["tile"], 8), "Y", 8)
    return transform.dequantize(q, "Y", 8).select("tile", "v", "u", "coef")


@tile_query
def idct(t):
    q = transform.quantize(transform.dct2d(t, ["tile"], 8), "Y", 8)
    return transform.idct2d(transform.dequantize(q, "Y", 8), ["tile"], 8).select("tile", "x", "y", F.round(F.col("val") + 1e-7, 4).alias("val"))


@tile_query
def level_histogram(t):
    q = transform.quantize(transform.dct2d(t, ["tile"], 8), "Y", 8).withColumn("chan", F.lit("Y"))
    return transform.level_histogram(q)


@tile_query
def zero_share(t):
    q = transform.quantize(transform.dct2d(t, ["tile"], 8), "Y", 8).withColumn("chan", F.lit("Y"))
    return transform.zero_share(q)


@tile_query
def level_overflow(t):
    wide = t.withColumn("val", F.col("val") * 40)
    return transform.level_overflow(transform.quantize(transform.dct2d(wide, ["tile"], 8), "Y", 8).withColumn("chan", F.lit("Y")))


def _residual(px):
    t, changed, vectors = _vectors(px)
    return transform.residual_blocks(cut(vectors), t, most=8, own=changed)


@query
def residual_deadzone(px):
    rows = _by_eight(transform.residuals(_residual(px)))
    return rows.withColumnsRenamed({"i": "x", "j": "y"})


@query
def encode_residuals(px):
    return _by_eight(transform.levels(transform.code_blocks(_residual(px)))).drop("sub")


@query
def leaf_residuals(px):
    """Levels of blocks of every size, in 8x8 parts or whole blocks of 4."""
    return transform.levels(codec.encode(px)[1])


@query
def leaf_overflow(px):
    """Levels and spans that seven bits can't hold."""
    return transform.record_overflow(codec.encode(px)[1])


@query
def payload_bytes(px):
    return stats.payload_bytes(codec.encode(px)[0])


# rebuilding


def _rebuilt(px):
    """Packed tiles, and the blocks rebuilt from their vectors' matches."""
    t, changed, vectors = _packed_vectors(px)
    return t, transform.rebuilt_matches(vectors, t, most=8, own=changed)


@query
def reconstruct(px):
    """Luma and chroma of every coded block."""
    return rebuild.reconstruct(_rebuilt(px)[1])


@query
def reconstruct_one(px):
    t, found = _rebuilt(px)
    return rebuild.reconstruct_step(t, found, frames.frame_index(t))


@query
def decode_open_loop(px):
    """Every frame rebuilt, step by step, from start frames and coded leaves: a checksum of each tile row."""
    out = tiles.to_planes(codec.decode(px, codec.encode(px)[1]))[0]
    return out.groupBy("video_id", "f", "y").agg(F.sum(F.expr("ym * (x + 1)")).alias("mark"), F.count("*").alias("n"))


@query
def encode_closed_loop(px):
    """Statistics of the frame-stepped encode against rebuilt references."""
    return codec.encode_closed_loop(px)[2].select("video_id", "f", "n_vectors", "area", F.round("mean_error", 6).alias("mean_error"), "n_uncoded")


@query
def overlay(px):
    y = planes.luma(px)
    return rebuild.overlay(y, y.where("x % 5 = 0").selectExpr("video_id", "f", "x", "y", "ym + 7 AS ym"))


@query
def patch_union(px):
    y = planes.luma(px)
    return rebuild.patch_union(y.where("x < 12"), y.where("x >= 8 AND x < 20").selectExpr("video_id", "f", "x", "y", "ym + 5 AS ym"))


@query
def edge_neighbours(px):
    y, vectors = planes.luma(px), _vectors(px)[2]
    e = rebuild.edge_neighbours(y, vectors, False)
    return e.select("video_id", "f", "ex", "ey", *[F.floor(F.col(n) * 1000 + 0.5).alias(n) for n in ("p2", "p1", "p0", "q0", "q1", "q2")])


def _smoothed(px, passes):
    t, _, vectors = _packed_vectors(px)
    return tiles.luma_rows(rebuild.smoothed(t, vectors, passes))


@query
def deblock_columns(px):
    return _smoothed(px, "x")


@query
def deblock_rows(px):
    return _smoothed(px, "y")


@query
def deblock_both(px):
    """Column edges first, then row edges on what that gives."""
    return _smoothed(px, "xy")


# statistics


@query
def frame_stats(px):
    s = codec.encode(px)[2]
    return s.withColumn("mean_error", F.round("mean_error", 6))


@query
def running_mean_error(px):
    return stats.running_mean_error(codec.encode(px)[2])


def _coded(px, **how):
    """Statistics, sizes and level totals of every coded frame."""
    vectors, coded, s = codec.encode(px, **how)
    levels = "flatten(array(ly, lu, lv))"
    sums = coded.groupBy("video_id", "f").agg(
        F.countDistinct("size").alias("n_sizes"),
        F.sum(F.expr(f"size({levels})")).cast("long").alias("n_levels"),
        F.sum(F.expr(f"aggregate({levels}, 0L, (t, l) -> t + l)")).cast("long").alias("level_sum"),
        F.sum(F.expr(f"aggregate({levels}, 0L, (t, l) -> t + abs(l))")).cast("long").alias("level_abs"),
    )
    return s.select("video_id", "f", "n_vectors", "area", F.round("mean_error", 6).alias("mean_error"), "n_uncoded").join(by_sort(sums), ["video_id", "f"])


@query
def encode_open_loop(px):
    return _coded(px)


@query
def encode_pattern(px):
    """The encode with the frontier of hexagons before the small window."""
    return _coded(px, window=4)


@query
def changed_per_frame(px):
    """Changed 8x8 blocks of every frame that has a predecessor."""
    t = _grid(px)
    changed = tiles.changed_leaves(t).groupBy("video_id", "f").agg(F.count("*").alias("n"))
    every = frames.frame_index(t).where("prev_f IS NOT NULL").select("video_id", "f")
    return every.join(by_sort(changed), ["video_id", "f"], "left").select("video_id", "f", F.coalesce("n", F.lit(0)).cast("long").alias("n_changed"))


# streams and tables


def _streamed(px, flow):
    """What a flow over frames that land in two parts commits: the second run goes on from the first one's state."""
    spark = px.sparkSession
    changes.stream_query_settings(spark)
    folder = own_folder(spark)
    for part in ("f < 3", "f >= 3"):
        px.where(part).write.mode("append").parquet(f"{folder}/in")
        out = flow(changes.stream_frames(spark, f"{folder}/in", px.schema, None))
        sink.stream_sink(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sink.read_committed(spark, f"{folder}/out", out.schema)


@query
def stream_changed_blocks(px):
    """Changed 8x8 blocks found by the stream."""
    return _streamed(px, changes.stream_changed_blocks).where("NOT late").drop("late")


@query
def stream_history(px):
    """The up to four frames before each frame, by the stream."""
    found = _streamed(px, changes.stream_history).where("NOT late")
    return found.select("video_id", "f", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query
def overwrite_table(px):
    """A table by video, of which every third video is written again with its red inverted; sums of what is read back."""
    path = own_folder(px.sparkSession) + "/table"
    frames.write_table(px, path)
    frames.write_table(px.where("video_id % 3 = 0").withColumn("r", F.expr("255 - r")), path, whole=False)
    got = frames.read_table(px.sparkSession, path)
    return got.groupBy("video_id", "f").agg(F.count("*").alias("n"), F.sum(F.expr("r * (x + 32 * y + 1)")).alias("mark"))


@tile_query
def merge_subtiles(t):
    """Tiles split to fours and put together again."""
    return blocks.merge_subtiles(blocks.split_subtiles(t, 4), 4)
