"""Per-frame statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import record_size
from ..sources.shared import by_sort


#: Costs of blocks of any size are brought to those of blocks of this many pixels, so that sums stay whole.
WHOLE = 16_384


def frame_stats(vectors: DataFrame, uncoded: DataFrame) -> DataFrame:
    """Vectors, covered area, mean match error (mean squares), uncoded blocks and area per frame."""
    area = F.sum(F.col("size") * F.col("size")).cast("long")
    v = vectors.groupBy("video_id", "f").agg(F.count("*").alias("n_vectors"), area.alias("area"), F.sum(F.expr(f"cost * ({WHOLE} div (size * size))")).cast("long").alias("cost"))
    u = uncoded.groupBy("video_id", "f").agg(F.count("*").alias("n_uncoded"), area.alias("uncoded_area"))
    both = v.join(by_sort(u), ["video_id", "f"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    error = F.coalesce("cost", F.lit(0)) / (F.coalesce("n_vectors", F.lit(1)) * F.lit(4e6 * WHOLE))
    return both.select("video_id", "f", zero("n_vectors"), zero("area"), error.alias("mean_error"), zero("n_uncoded"), zero("uncoded_area"))


def running_mean_error(stats: DataFrame) -> DataFrame:
    """Mean of the frames' mean errors so far."""
    w = Window.partitionBy("video_id").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    return stats.select("video_id", "f", F.round(F.avg("mean_error").over(w), 6).alias("running_error"))


def payload_bytes(vectors: DataFrame) -> DataFrame:
    """Bytes of a frame's records and its start byte."""
    return vectors.groupBy("video_id", "f").agg((F.sum(record_size(F.col("size"))) + 1).cast("long").alias("bytes"))


def packing_ratio(vectors: DataFrame, pixels: DataFrame) -> DataFrame:
    """Bytes of a frame's records, of its pixels at three bytes each, and the second over the first in thousandths; a frame without vectors has its start byte."""
    raw = pixels.groupBy("video_id", "f").agg((3 * F.count("*")).cast("long").alias("raw_bytes"))
    both = raw.join(by_sort(payload_bytes(vectors)), ["video_id", "f"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(1)).cast("long"))
    return both.select("video_id", "f", "raw_bytes", "bytes", F.expr("raw_bytes * 1000 div bytes").cast("long").alias("ratio_milli"))


def match_offsets(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("ref", "span_x", "span_y").agg(F.count("*").alias("n"))
