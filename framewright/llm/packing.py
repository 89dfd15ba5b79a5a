"""Best-fit packing planned on the length histogram.

Documents become token ids and are cut into pieces of at most ``limit``.  The
plan is made on counts: at most ``limit`` numbers reach the driver, where
best-fit decreasing fills runs of identical sequences at a time.  Each plan row
says which ranks of a length go to which run of sequences; pieces take their
slots by joining on (length, rank within length).
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

PLAN = "length int, rank_from long, rank_to long, first_sequence long, each int, at int"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict = {}
#: Distinct words whose ids a worker keeps; beyond, it starts anew.
_KEPT_WORDS = 1_000_000


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _encode_cores(tok, path: str, words: list[str]) -> list[bytes]:
    """Ids of each word, many words a call.

    A word of letters alone ends with its one end-of-word id, so a run of such
    words is encoded as one text and cut there; if the ends don't come out one
    a word, or a word has other characters, words are encoded one by one.
    """
    import numpy as np

    if ("ends", path) not in _loaded:
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for w, i in tok.get_vocab().items() if w.endswith("</w>")]] = True
        _loaded["ends", path] = ends
    ends = _loaded["ends", path]
    if len(words) > 1 and all(map(str.isalpha, words)):
        ids = np.array(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) == len(words) and stop[-1] == len(ids):
            code, at = ids.tobytes(), [0, *(4 * stop).tolist()]
            return [code[i:j] for i, j in zip(at, at[1:], strict=False)]
    return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]


class _Known:
    """Ids of the distinct parts a worker has met, found by their bytes."""

    def __init__(self) -> None:
        import numpy as np

        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.start, self.count, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, parts: list[bytes], codes: list[bytes]) -> None:
        import numpy as np

        flat = np.frombuffer(b"".join(codes), "<u4")
        n = len(self.slot)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(codes) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        counts = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(codes)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(codes)] = counts
        self.used += len(flat)
        self.slot.update(zip(parts, range(n, n + len(codes)), strict=True))


def _classes():
    import numpy as np

    kind = np.full(256, 3, np.uint8)
    kind[[32, 9, 10, 11, 12, 13]] = 0
    kind[list(b".,!?;:%*&#$")] = 1
    kind[48:58] = kind[65:91] = kind[97:123] = 2
    return kind


def _encode_slice(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of texts of at most PIECE bytes in all."""
    import numpy as np

    from .shingles import Spans

    tok = _tokenizer(path)
    if ("known", path) not in _loaded or len(_loaded["known", path].slot) > _KEPT_WORDS:
        _loaded["known", path] = _Known()
    known: _Known = _loaded["known", path]
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    kind = _loaded.setdefault("classes", _classes())[data]
    last = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    begins = (kind > 0) & ((last == 0) | ((kind == 1) & (last == 2)) | ((kind == 2) & (last == 1)))
    start = np.flatnonzero(begins)
    end = np.flatnonzero((last > 0) & ((kind == 0) | begins))
    spans = Spans(data, start, end)
    _, first, where = np.unique(spans.hashes(), return_index=True, return_inverse=True)
    if not spans.equal(first[where]):  # two parts share a fingerprint
        return [_whole(t, path) for t in texts]
    keys = [spans.bytes(i) for i in first.tolist()]
    slots = np.fromiter((known.slot.get(k, -1) for k in keys), np.int64, len(keys))
    new = np.flatnonzero(slots < 0)
    if len(new):
        words = [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        codes: list[bytes] = [b""] * len(words)
        alpha = [i for i, w in enumerate(words) if w.isalpha()]
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        for group in (alpha, other):
            for at in range(0, len(group), 2000):
                run = group[at : at + 2000]
                for i, code in zip(run, _encode_cores(tok, path, [words[i] for i in run]), strict=True):
                    codes[i] = code
        slots[new] = len(known.slot) + np.arange(len(new))
        known.add([keys[i] for i in new.tolist()], codes)
    slot = slots[where]
    count = known.count[slot]
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    code = known.ids[np.repeat(known.start[slot] - (stop - count), count) + np.arange(total)].tobytes()
    edges = np.cumsum([len(t) + 1 for t in texts])
    at = [0, *np.concatenate([[0], stop])[np.searchsorted(start, edges)].tolist()]
    return [code[4 * i : 4 * j] for i, j in zip(at, at[1:], strict=False)]


def encode_words(texts: list[bytes], path: str) -> list[bytes]:
    """Each UTF-8 text's ids as little-endian 32-bit numbers.

    The tokenizer lower-cases, drops white space and never joins what it
    separates, nor ASCII letters or digits with common ASCII punctuation.  So
    a text's ids are those of its parts between such places, one after another;
    parts repeat a lot, so each distinct one is encoded once.
    """
    from .shingles import PIECE, in_slices

    out: list[bytes] = []
    for a, b in in_slices(texts, PIECE // 2):
        if b - a == 1 and len(texts[a]) >= PIECE // 2:
            out.append(b"".join(_encode_slice([x], path)[0] if len(x) < PIECE else _whole(x, path) for x in _runs(texts[a], PIECE // 2)))
        elif sum(map(len, texts[a:b])) + b - a >= PIECE:  # a long text closes the slice
            out += _encode_slice(texts[a : b - 1], path) + encode_words([texts[b - 1]], path)
        else:
            out += _encode_slice(texts[a:b], path)
    return out


def _runs(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end at blanks."""
    import re

    at = 0
    while at < len(text):
        blank = re.compile(rb"[ \t-\r]").search(text, at + size)
        to = blank.end() if blank else len(text)
        yield text[at:to]
        at = to


def _whole(text: bytes, path: str) -> bytes:
    import numpy as np

    return np.array(_tokenizer(path).encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of each document's ids followed by ``end_id``: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import as_bytes, in_slices

        end = np.array([end_id], "<u4").tobytes()
        width = 4 * limit
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            rows: list[list] = [[], [], [], [], []]
            for a, b in in_slices(texts):
                for doc, code in zip(ids[a:b], encode_words(texts[a:b], tokenizer), strict=True):
                    code += end
                    for k, at in enumerate(range(0, len(code), width)):
                        part = code[at : at + width]
                        for col, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def plan_best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length -> count): rows as in ``PLAN``.

    Sequences that are filled alike form runs of consecutive numbers, so the
    plan's size depends on ``limit`` and not on the number of documents.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: list[int] = []  # sorted rooms that occur
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    used = 0

    def leave(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in runs:
                bisect.insort(room, size)
                runs[size] = []
            runs[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                size = room[at]
                first, n = runs[size].pop()
                if not runs[size]:
                    del runs[size], room[at]
            else:
                size, first, n = limit, used, -(-left // (limit // length))
                used += n
            each = size // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, limit - size))
                rank, left = rank + full * each, left - full * each
                leave(size - each * length, first, full)
                first, n = first + full, n - full
            if n and left:  # fewer than ``each`` are left: one sequence takes them
                rows.append((length, rank, rank + left, first, left, limit - size))
                leave(size - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(size, first, n)
    return rows


def pack(pieces: DataFrame, limit: int = 4096, salts: int = 64) -> DataFrame:
    """Give every piece (``length`` from 1 to ``limit``) a ``sequence_id`` and ``offset``.

    Ranks within a length are counted in ``salts`` parts whose sizes are then
    added up, so a length that most pieces share is not ranked in one task.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    order = pieces.columns
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    plan = spark.createDataFrame(plan_best_fit(counts, limit), PLAN)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(ahead, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "salt")
    slot = F.col("rank") - F.col("rank_from")
    on = (ranked.length == plan.length) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(plan), on).select(  # the plan's size is bounded by ``limit``
        *[ranked[c] for c in order],
        (F.col("first_sequence") + F.expr("(rank - rank_from) div each")).cast("long").alias("sequence_id"),
        (F.col("at") + (slot % F.col("each")) * ranked.length).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    Null and empty texts are one piece with only the end id; repeated rows are
    packed each; an empty table gives an empty result; other columns are
    ignored.
    """
    return pack(token_pieces(docs, tokenizer, limit), limit)
