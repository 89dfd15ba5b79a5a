"""Quality score from compression with two dictionaries.

One zstandard dictionary is built from text labelled good and one from text
labelled bad.  A document is compressed in blocks with each; the difference of
the compressed sizes over the length, with the plain compressed share beside
it, goes through a logistic calibration fitted on labelled texts that built
neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    level: int = 3


def _compressors(good: bytes, bad: bytes, level: int):
    import zstandard as z

    kind = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    make = lambda d: z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(d), **kind)
    return make(good), make(bad), z.ZstdCompressor(level=level, **kind)


def _features(text: bytes, by: tuple) -> list[float]:
    """Difference, mean and plain compressed size over the length; log length."""
    sizes = [0, 0, 0]
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        for i, c in enumerate(by):
            sizes[i] += len(c.compress(part))
    n = max(1, len(text))
    good, bad, plain = (s / n for s in sizes)
    return [1.0, (bad - good) * 10, min(3.0, plain) * 5, (good - plain) * 5, np.log1p(n) / 4]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(size, [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]).as_bytes()
    except z.ZstdError:  # too few samples for training: their text itself serves
        return b"\n".join(texts)[-size:] or b"."


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _blocks(docs: DataFrame) -> DataFrame:
    """(h, k, block) of whole texts from rows (h, text): blocks of BLOCK bytes, k being a block's number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["h", "k", "block"])

    return docs.select("h", "text").mapInArrow(run, "h long, k long, block binary")


def fit(
    docs: DataFrame, labels: DataFrame, most_per_label: int = 3000, most_blocks: int = 6000, dictionary_bytes: int = 65_536, level: int = 3
) -> QualityModel:
    """Fit on documents (doc_id, text) and labels (doc_id, quality).

    At most ``most_per_label`` ids of each label, chosen by a hash, are broadcast
    to the documents.  The dictionaries are built from at most ``most_blocks``
    blocks of BLOCK bytes of each label's texts, chosen by a hash from all blocks
    of the whole texts.  Even halves of the ids build the dictionaries and odd
    halves the calibration, then the other way round.  The calibration's features
    are those of the whole texts, taken on the executors.  Null and empty texts
    have no blocks; rows that repeat an id are in one half; with one label only,
    or none, every score is 0.5.
    """
    rows, parts = [], []
    hashed = F.xxhash64("doc_id")
    for label in (0, 1):
        ids = labels.where(F.col("quality") == label).select("doc_id").distinct().orderBy(hashed, "doc_id").limit(most_per_label)
        own = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(hashed.alias("h"), "text")
        halves = {h: i % 2 for i, h in enumerate(sorted(r.h for r in ids.select(hashed.alias("h")).collect()))}
        blocks = _blocks(own).orderBy(F.xxhash64("h", "k"), "h", "k").limit(most_blocks)
        rows += [(label, halves[r.h], bytes(r.block)) for r in blocks.collect()]
        parts.append((label, own, halves))
    if len({r[0] for r in rows}) < 2:
        return QualityModel(b".", b".", np.zeros(5), level)
    pairs = [tuple(_dictionary([t for q, i, t in rows if q == label and i == half], dictionary_bytes) for label in (1, 0)) for half in (0, 1)]
    x, y = [], []
    for label, part, halves in parts:
        found = _whole_features(part, halves, pairs, level)
        x += found
        y += [label] * len(found)
    dicts = [_dictionary([t for q, _, t in rows if q == label], dictionary_bytes) for label in (1, 0)]
    return QualityModel(*dicts, _logistic(np.array(x), np.array(y, float)), level)


def _whole_features(part: DataFrame, halves: dict[int, int], pairs: list[tuple], level: int) -> list[list[float]]:
    """Features of whole texts of rows (h, text), by the dictionaries of the half that h isn't in."""
    shared = part.sparkSession.sparkContext.broadcast((halves, pairs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        halves, pairs = shared.value
        by = [_compressors(*p, level) for p in pairs]
        for batch in batches:
            h = batch.column(0).to_pylist()
            x = [_features(t.as_buffer().to_pybytes() if t.is_valid else b"", by[1 - halves[k]]) for k, t in zip(h, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["h", "x"])

    return [x for _, x in sorted((r.h, list(r.x)) for r in part.mapInArrow(run, "h long, x array<double>").collect())]


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null texts count as empty.

    Empty texts get the score of length 0.  Repeated rows get equal scores, an
    empty table an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights, model.level))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        good, bad, weights, level = shared.value
        by = _compressors(good, bad, level)
        for batch in batches:
            x = np.array([_features(b"" if t is None else t.as_buffer().to_pybytes(), by) if t is not None and t.is_valid else _features(b"", by) for t in batch.column(1)]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
