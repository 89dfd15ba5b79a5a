"""Packing planned by cutting-stock column generation; cut documents fill what the plan leaves free.

Documents become items of at most ``limit`` tokens, and items fall into length
classes of ``width`` tokens.  On the histogram of the classes (``limit / width``
numbers) a linear program chooses how often to use each pattern, a multiset of
classes whose upper ends fit a sequence; new patterns are priced by a knapsack
over the program's dual prices until none is worth more than a sequence.  The
counts are rounded down, patterns become runs of sequences, and items take
their places by rank within their class.

Items that the rounded plan leaves over go on a tape, one after another, which
flows through the free ends of the planned sequences.  The plan is scaled down
until the tape is long enough to fill them all.  The tape's rest makes whole
sequences, and what is left then is cut at powers of two, which need no
padding.  So only items of the tape are cut, and no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import encode_words
from .store import Scratch

#: Width of a length class in tokens.
WIDTH = 16
PLAN = "class int, rank_from long, rank_to long, first long, each long"
#: Rows of one part of a ranking, and tokens of one part of the tape.
PART_ROWS, PART_TOKENS = 50_000, 1 << 18
_ITEMS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def token_items(docs: DataFrame, tokenizer: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id`` in items of ``limit`` tokens, the last one shorter."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import as_bytes, in_slices

        end, size = np.array([end_id], "<u4").tobytes(), 4 * limit
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in in_slices(texts):
                rows: list[list] = [[] for _ in names]
                for doc, code in zip(ids[a:b], encode_words(texts[a:b], tokenizer), strict=True):
                    code += end
                    for at in range(0, len(code), size):
                        part = code[at : at + size]
                        for col, v in zip(rows, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(code) // 4, part), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _ITEMS)


def price_pattern(value, size: int):
    """The most valuable multiset of classes 1..size whose sum is at most ``size``: (value, counts by class)."""
    import numpy as np

    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        worth = value[1 : room + 1] + best[room - 1 :: -1]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], last[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(size + 1, np.int64), size
    while room:
        k = int(last[room])
        counts[k] += k > 0
        room -= k or 1
    return best[size], counts


def solve_patterns(demand: dict[int, int], size: int, tolerance: float = 1e-4):
    """Patterns and how often to use each (fractions): (list of {class: count}, list of uses, lower bound).

    Revised simplex on columns that ``price_pattern`` makes.  It ends when the
    best column is worth no more than a sequence, or when the uses are within
    ``tolerance`` of the bound that the prices prove.
    """
    import numpy as np

    classes = sorted(demand)
    m = len(classes)
    if not m:
        return [], [], 0.0
    need = np.array([demand[c] for c in classes], float)
    scale = need.sum()
    need = need / scale * (1 + 1e-9 * np.arange(1, m + 1))  # no two ratios alike, so every step gains
    columns = [{c: size // c} for c in classes]
    inverse = np.diag([1.0 / (size // c) for c in classes])
    uses, bound, turn = inverse @ need, 0.0, 0
    while True:
        turn += 1
        if turn % 200 == 0:  # rounding errors of the updates go
            inverse = np.linalg.inv(np.array([[p.get(c, 0) for p in columns] for c in classes], float))
            uses = np.maximum(inverse @ need, 0)
        prices = inverse.sum(axis=0)
        value = np.full(size + 1, -1.0)
        value[classes] = np.maximum(prices, 0)
        worth, counts = price_pattern(value, size)
        if worth > 0:
            bound = max(bound, float(np.maximum(prices, 0) @ need) / max(1.0, worth))
        if worth <= 1 + 1e-9 or uses.sum() <= bound * (1 + tolerance):
            break
        column = counts[classes].astype(float)
        step = inverse @ column
        able = step > 1e-12
        ratio = np.where(able, uses / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        gain = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        uses = uses - gain * step
        uses[out] = gain
        np.maximum(uses, 0, out=uses)
        columns[out] = {c: int(counts[c]) for c in classes if counts[c]}
    return columns, list(uses * scale), bound * scale


def plan_rows(columns: list[dict[int, int]], uses: list[float], counts: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rows as in ``PLAN``, sequences): uses rounded down; a class's ranks are dealt to patterns in order."""
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for pattern, use in zip(columns, uses, strict=True):
        n = int(use + 1e-7)
        filled = min((-(-(counts[c] - taken[c]) // k) for c, k in pattern.items()), default=0)
        n = min(n, max(0, filled))  # no sequence without an item of each kind
        if not n:
            continue
        for c, k in pattern.items():
            to = min(taken[c] + n * k, counts[c])
            if to > taken[c]:
                rows.append((c, taken[c], to, first, k))
            taken[c] = to
        first += n
    return rows, first


def ranked(dealt: DataFrame, store: Scratch) -> DataFrame:
    """Items with their rank within their class from 0, counted in parts and added up."""
    sizes = dealt.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("class", "part").orderBy("key")
    out = dealt.withColumn("in_part", F.row_number().over(inside) - 1).join(ahead, ["class", "part"])
    return store.cut(out.withColumn("rank", F.col("in_part") + F.col("ahead")).drop("in_part", "ahead"))


def laid_out(rows: DataFrame, key: Column, length: str, store: Scratch, n: int) -> DataFrame:
    """Rows with ``at``, the sum of ``length`` of all rows before: totals of hash parts first, then sums inside them."""
    parts = min(65_536, max(16, -(-n // PART_ROWS)))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    totals = dealt.groupBy("_part").agg(F.sum(length).alias("total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    starts = totals.select("_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(F.broadcast(starts), "_part")
    return out.withColumn("at", (F.col("_in") + F.col("_start")).cast("long")).drop("_part", "_in", "_start")


def overlaps(tape: DataFrame, gaps: DataFrame, part: int = PART_TOKENS) -> DataFrame:
    """Where items of the tape (key, at, length) meet gaps (sequence_id, offset, at, length): (key, start, length, sequence_id, offset).

    Both cover the tape without holes.  The tape is dealt out in parts of
    ``part`` tokens; inside one, every begin is a row and takes the last item
    and the last gap begun before it, so the work is linear.
    """
    in_parts = F.explode(F.sequence(F.expr(f"at div {part}"), F.expr(f"(at + length - 1) div {part}")))
    begin = F.greatest(F.col("at"), F.col("part") * part).alias("pos")
    end = F.least(F.col("at") + F.col("length"), (F.col("part") + 1) * part).alias("stop")
    a = tape.select("*", in_parts.alias("part")).select("part", begin, end, F.struct("key", "at").alias("item"), F.lit(None).cast("struct<sequence_id:bigint,offset:bigint,at:bigint>").alias("gap"))
    b = gaps.select("*", in_parts.alias("part")).select("part", begin, end, F.lit(None).cast("struct<key:bigint,at:bigint>").alias("item"), F.struct("sequence_id", "offset", "at").alias("gap"))
    w = Window.partitionBy("part").orderBy("pos")
    so_far = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = a.unionByName(b).select(
        "pos",
        F.last("item", ignorenulls=True).over(so_far).alias("item"),
        F.last("gap", ignorenulls=True).over(so_far).alias("gap"),
        F.coalesce(F.lead("pos").over(w), F.max("stop").over(Window.partitionBy("part"))).alias("stop"),
    )
    rows = rows.where("stop > pos").select("item.key", (F.col("pos") - F.col("item.at")).alias("start"), (F.col("stop") - F.col("pos")).alias("length"), "gap.sequence_id", (F.col("gap.offset") + F.col("pos") - F.col("gap.at")).alias("offset"))
    # a piece may have been cut where a part of the tape ends
    return rows.groupBy("key", "sequence_id").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset"))


def with_class(items: DataFrame, width: int, parts: int) -> DataFrame:
    """Items with their length class and their part of its ranking."""
    return items.withColumns({"class": F.expr(f"CAST((length + {width - 1}) div {width} AS INT)"), "part": F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")})


def cut_checksums(pieces: DataFrame, items: DataFrame) -> DataFrame:
    """Checksums of the pieces' ids; each item's pieces meet its ids once."""
    each = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, begin, total, ids, cuts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for c in cuts:
                    crc = zlib.crc32(ids[4 * c["start"] : 4 * (c["start"] + c["length"])])
                    for col, v in zip(rows, (doc, begin + c["start"], c["length"], crc, total, c["sequence_id"], c["offset"]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=list(names))

    return items.join(each, "key").select("doc_id", F.col("start").alias("begin"), "doc_tokens", "ids", "cuts").mapInArrow(run, kind)


def pack_cutting(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, width: int = WIDTH, store: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have only the end id; repeated rows are packed each;
    very long texts are cut into items of ``limit`` tokens; an empty table gives
    an empty result; other columns are ignored.  Sequences are full, but for
    at most one of each power of two below ``limit``.
    """
    if limit % width or limit & (limit - 1):
        raise ValueError("limit must be a power of two and a multiple of width")
    store = store or Scratch()
    items = token_items(docs, tokenizer, limit, end_id).withColumn("key", F.monotonically_increasing_id())
    items = store.cut(items)  # written, so that keys stay
    n, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(64, -(-n // PART_ROWS))
    order = ranked(with_class(items.select("key", "length"), width, parts), store)
    counts = {r["class"]: r.n for r in order.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most limit / width rows
    columns, uses, _ = solve_patterns(counts, limit // width)
    spark, share = docs.sparkSession, 1.0
    while True:
        plan, sequences = plan_rows(columns, [u * share for u in uses], counts)
        kept = {}
        for c, _, to, _, _ in plan:
            kept[c] = max(kept.get(c, 0), to)
        last = spark.createDataFrame(list(kept.items()) or [(-1, 0)], "class int, kept long")  # a row a class
        placed = order.join(F.broadcast(last), "class").where("rank < kept").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        free, tape_tokens = sequences * limit - placed, tokens - placed
        if tape_tokens >= free:
            break
        short = (free - tape_tokens) / max(1, sequences * limit)
        share = max(0.0, share - max(1.05 * short, 1e-4)) if sequences > 1 else 0.0
    table = F.broadcast(spark.createDataFrame(plan or [(-1, 0, 0, 0, 1)], PLAN))  # bounded by patterns, at most limit / width of them
    on = (order["class"] == table["class"]) & (order["rank"] >= table["rank_from"]) & (order["rank"] < table["rank_to"])
    placed = order.join(table, on).select(order["key"], order["length"], (F.col("first") + F.expr("(rank - rank_from) div each")).alias("sequence_id"))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key")
    placed = store.cut(
        placed.select(
            "key",
            "sequence_id",
            (F.sum("length").over(in_sequence.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
            F.sum("length").over(Window.partitionBy("sequence_id")).alias("filled"),
        )
    )
    gaps = placed.where("offset = 0 AND filled < " + str(limit)).select("sequence_id", F.col("filled").alias("offset"), (limit - F.col("filled")).alias("length"))
    gaps = laid_out(gaps, F.col("sequence_id"), "length", store, sequences)
    rest = tape_tokens - free
    whole = spark.range(rest // limit).select((F.lit(sequences) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(limit).cast("long").alias("length"), (F.lit(free) + F.col("id") * limit).alias("at"))
    ends, at, k = [], tape_tokens - rest % limit, sequences + rest // limit
    for bit in range(limit.bit_length() - 1, -1, -1):
        if rest % limit >> bit & 1:
            ends.append((k, 0, 1 << bit, at))
            at, k = at + (1 << bit), k + 1
    gaps = gaps.unionByName(whole)
    if ends:
        gaps = gaps.unionByName(spark.createDataFrame(ends, "sequence_id long, offset long, length long, at long"))
    tape = order.join(F.broadcast(last), "class", "left").where("kept IS NULL OR rank >= kept").select("key", "length", "part", "class")
    tape = store.cut(laid_out(tape, F.col("key"), "length", store, n))
    pieces = store.cut(overlaps(tape.select("key", "at", "length"), gaps))
    # the tape has the last ranks of each class, so the last parts of its ranking
    floors = F.broadcast(tape.groupBy("class").agg(F.min("part").alias("from")))  # a row a class
    taped = with_class(items, width, parts).join(floors, "class").where(F.col("part") >= F.col("from"))
    out = items.drop("ids").join(placed.select("key", "sequence_id", "offset"), "key")
    columns_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*columns_out).unionByName(cut_checksums(pieces, taped.select("key", "doc_id", "start", "doc_tokens", "ids")).select(*columns_out))
