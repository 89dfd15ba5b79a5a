"""From candidate keys to connected groups, without all pairs of a key.

``linked_groups`` gets (key, node, leader) rows and a function that verifies
pairs.  First every key's nodes are compared with one leader, and linked nodes
merge into groups.  From then on only keys whose nodes are in different groups
matter.  One of up to ``few`` nodes has its pairs of different groups looked at: a
bounded number for each row.  A larger one is split: its nodes get finer keys, so
chosen that any two that may link and are not linked by the split itself have one
in common.  Finer keys go the same way until no key has nodes of different groups.
No link between different groups is missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FILE_ROWS, Scratch

#: A written table of up to this many bytes is broadcast, a longer one joined by a shuffle.
SMALL_BYTES = 4 << 20
#: Up to so many edges (16 bytes each) are joined up without Spark.
FEW_EDGES = 25_000


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``df``, to be broadcast if it is a written table that is short for its rows' size."""
    rows = SMALL_BYTES // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _least_of(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node reachable) of a short list of edges."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [(i, top(i)) for i in list(up)]


def components(edges: DataFrame, cut: Callable) -> DataFrame:
    """(node, group) for the nodes of the edges (a, b): group is the smallest node reachable.

    Large-star and small-star steps in turn, written to the shared folder, until
    every node points at a root; both are a grouped minimum and a join.  Up to
    ``FEW_EDGES`` edges, where those steps are jobs of next to nothing, are joined up
    by the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    n = now.count()
    if n <= FEW_EDGES:
        found = _least_of([(r.u, r.v) for r in now.collect()])
        return cut(edges.sparkSession.createDataFrame(found, "node long, group long"), len(found))
    while True:
        n = 2 * now.count()
        seen = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))))
        ends = now.select(seen.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("lo"), F.max("e.to").alias("hi"), F.count(F.when(F.col("e.to").isNull(), 1)).alias("below"))
        ends = cut(ends, n)
        if not ends.where("lo <> hi OR (lo IS NOT NULL AND below > 0)").head(1):
            break
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut(turned.select("e.u", "e.v").where("u <> v").distinct(), n)
    return ends.select("node", F.coalesce("lo", "node").alias("group"))


def merged(groups: DataFrame, more: DataFrame, cut: Callable) -> DataFrame:
    """The groups (node, group) after more links (a, b): only the groups that the links touch are looked at."""
    for s in "ab":
        at = groups.select(F.col("node").alias(s), F.col("group").alias("g" + s))
        more = more.join(small(at), s, "left").withColumn(s, F.coalesce("g" + s, s)).drop("g" + s)
    found = components(more.where("a <> b").distinct(), cut)
    turned = groups.join(small(found.select(F.col("node").alias("group"), F.col("group").alias("to"))), "group", "left")
    # a group's name is one of its nodes; nodes new here are named by themselves
    return cut(turned.select("node", F.coalesce("to", "group").alias("group")).union(found.select("node", "group")).distinct(), groups.count() + found.count())


def all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one key and different groups from rows (key, node, group) of short keys."""
    x, y = (rows.select("key", F.col("node").alias(s), F.col("group").alias("g" + s)) for s in "ab")
    return x.join(y, "key").where("ga <> gb AND a < b").select("a", "b").distinct()


def linked_groups(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]],
    tables: Scratch,
    pairs_of: Callable[[DataFrame], DataFrame] = all_pairs,
    few: int = 16,
) -> DataFrame:
    """(node, group) of the nodes that link with another one.

    ``shared`` has (key, node, leader) rows of keys that two nodes or more have,
    the leader being any one of them.  ``verify`` keeps the pairs (a, b) that
    link.  ``pairs_of`` makes the pairs of keys of up to ``few`` nodes from rows
    (key, node, group, c, alike), ``alike`` being the number of keys with the same
    nodes; it may leave out pairs that can't link.  ``split`` turns such rows
    of larger keys into links (a, b), pairs (a, b) to be verified, and the finer
    keys' rows (key, node).  Turns go on until no key has nodes of different groups.
    """
    cut = tables.cut
    pair = [F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")]
    fresh = cut(shared.where("node <> leader").select(*pair).distinct())
    tested, keys = fresh, shared.select("key", "node")
    links = cut(verify(fresh), fresh.count(), deal=True)
    groups = components(links, cut)
    while True:
        at = keys.join(small(groups), "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"))
        cross = at.groupBy("key").agg(
            F.count("*").alias("c"), F.min("group").alias("lo"), F.max("group").alias("hi"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("print")
        ).where("lo < hi")
        # keys with the same nodes (a passage in several documents gives many) give the same pairs: one of them is enough
        cross = cross.groupBy("c", "first", "last", "print").agg(F.min("key").alias("key"), F.count("*").alias("alike"))
        cross = cut(cross.select("key", "c", "alike"), FILE_ROWS)
        rows, most = cross.agg(F.sum("c"), F.max("c")).first()
        if not rows:
            return groups
        wide = cut(at.join(small(cross), "key"), rows)
        fresh, sure = pairs_of(wide.where(F.col("c") <= few)), None
        if most > few:
            sure, probes, finer = split(wide.where(F.col("c") > few))
            fresh, keys = fresh.unionByName(probes).distinct(), cut(finer)
        fresh = cut(fresh.join(tested, ["a", "b"], "left_anti"), rows)
        more = cut(verify(fresh), fresh.count(), deal=True)
        more = more if sure is None else more.unionByName(sure)
        tested = tested.unionByName(fresh)
        if more.head(1):
            groups = merged(groups, more, cut)
        if most <= few:
            return groups
