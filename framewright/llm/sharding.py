"""Sharding by a Feistel permutation with cycle walking (DataFrame functions only).

Rows get global numbers 0..N-1 without a single-task sort: rows are counted by
(id, size, checksum), these go to hash buckets, a bucket's rows are numbered in
order, and the buckets' running totals are added.  Permuting the number gives
a reproducible shuffle whose shard is ``p mod shards`` and slot ``p div shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

ROUNDS = 6
MAX_WALK = 64


def _rounds(x: Column, side: int, seed: int, inverse: bool) -> Column:
    """One pass over the square of numbers ``side * side``; halves are digits to base ``side``."""
    keys = [F.lit(k).cast("long") for k in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))]
    start = F.struct(
        F.call_function("div", x, F.lit(side).cast("long")).alias("l"), (x % side).cast("long").alias("r")
    )

    def noise(half: Column, k: Column) -> Column:
        return F.pmod(F.xxhash64(half, k, F.lit(seed)), F.lit(side).cast("long"))

    def forward(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + noise(s["r"], k)) % side).cast("long").alias("r"))

    def back(s: Column, k: Column) -> Column:
        return F.struct(F.pmod(s["r"] - noise(s["l"], k), F.lit(side).cast("long")).alias("l"), s["l"].alias("r"))

    return F.aggregate(F.array(*keys), start, back if inverse else forward, lambda s: s["l"] * side + s["r"])


def permute(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """Where row number ``x`` of ``n`` goes; with ``inverse``, which row number went to ``x``.

    The square has at most ``2 sqrt(n) + 1`` numbers that are no rows, so a walk
    rarely takes a second step.  Up to n = 900 no walk can be longer than the 61
    numbers outside; beyond that 64 steps outside in a row have a chance of at
    most ``n * (2 / sqrt(n) + 1 / n)**64``, under 1e-70.  Such a walk would raise an
    error rather than lose a row.
    """
    side = max(1, math.isqrt(max(0, n - 1)) + 1)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        _rounds(x, side, seed, inverse),
        lambda y, _: F.when(y < n, y).otherwise(_rounds(y, side, seed, inverse)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long; choose another seed")).cast("long"))


def numbered(rows: DataFrame, keys: list[str], per_bucket: int = 250_000) -> tuple[DataFrame, int]:
    """(rows with ``row_no``, N).  Rows equal in all ``keys`` are interchangeable.

    ``rows`` may hold nothing but ``keys``.  The number of buckets follows N
    (64 to 65,536), so the table of bucket offsets has a fixed bound.
    """
    counted = cut(rows.groupBy(*keys).agg(F.count("*").alias("copies")))
    n = counted.agg(F.sum("copies")).first()[0] or 0
    buckets = min(65_536, max(1024, -(-n // per_bucket)))
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy("bucket").agg(F.sum("copies").alias("total"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    block = 4096
    out = (
        dealt.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("_block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {block})")))
        .withColumn("_i", F.explode(F.expr(f"sequence(_block * {block}, least(copies, (_block + 1) * {block}) - 1)")))
        .select(*keys, (F.col("ahead") + F.col("first") + F.col("_i")).alias("row_no"))
    )
    return out, n


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 20_240_501, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard sizes differ by one row at most, slots have no gaps.
    Null texts have no bytes; repeated rows each get a place of their own; an
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = numbered(digest, ["doc_id", "size", "text_crc32"])
    place = permute(F.col("row_no"), n, seed)
    return rows.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
