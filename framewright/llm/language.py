"""Language identification by Bayesian evidence fusion.

Evidence of a document: its text under byte-trigram models (learned from all
texts by their declared language), the declared language, the address suffix and
its host.  How far declarations and suffixes can be trusted, and the hosts'
priors, come from grouped counts of the languages that texts alone suggest; a
host's prior is smoothed towards its domain's and that towards the whole
corpus's.  One more class, ``und``, stands for text of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, salted_lookup

LANGS = ("de", "en", "es", "fr")
BUCKETS = 1 << 13
#: Trigrams overlap and repeat, so a text counts as at most this many independent ones.
WORTH = 40.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_PIECE = 1 << 20


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of every byte trigram; anything but letters is a blank."""
    b = _FOLD[data].astype(np.uint32)
    code = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int32)


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, max(1, len(data) - 2), _PIECE):
        yield data[at : at + _PIECE + 2]


def learn(docs: DataFrame, langs: tuple[str, ...] = LANGS) -> np.ndarray:
    """Log-probabilities (language, bucket) from (declared, text) rows; counts cover all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang in langs and text.is_valid:
                    for data in _pieces(text.as_buffer().to_pybytes()):
                        count[langs.index(lang)] += np.bincount(_trigrams(data), minlength=BUCKETS)
        k, b = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(count[k, b])], ["k", "b", "n"])

    sums = docs.select("declared", "text").mapInArrow(run, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    total = np.full((len(langs), BUCKETS), 0.5)
    for r in sums.collect():  # at most languages * buckets rows
        total[r.k, r.b] += r.n
    return np.log(total / total.sum(1, keepdims=True))


def text_evidence(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds ``letters`` (share of letter bytes) and ``ll`` (log-likelihood by language, then ``und``) in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([model, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32).copy())
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            ll, letters = np.zeros((batch.num_rows, table.shape[1])), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n = good = 0
                for data in _pieces(raw):
                    folded = int((_FOLD[data[1:-1]] != 32).sum())
                    if folded:
                        counts = np.bincount(_trigrams(data), minlength=BUCKETS)
                        counts[_BLANKS] = 0
                        used = np.flatnonzero(counts)
                        ll[i] += counts[used] @ table[used]
                        n += int(counts.sum())
                    good += folded
                letters[i] = good / max(1, len(raw))
                ll[i] *= min(1.0, WORTH / max(n, 1))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(letters), flat], [*names, "letters", "ll"])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(run, f"{kinds}, letters double, ll array<double>")


_BLANKS = int(_trigrams(np.full(3, 32, np.uint8))[0])


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, suffix hint) of an address: a two-letter path head or top domain."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return host, F.when(path != "", path).otherwise(top)


def markup_language(text: Column) -> Column:
    """The two-letter language that the text's own markup declares (``<html lang=``, ``xml:lang=``), or null."""
    found = F.lower(F.regexp_extract(text, r"<[A-Za-z][^<>]{0,200}?\b(?:xml:)?[lL][aA][nN][gG]\s{0,3}=\s{0,3}[\"']?([A-Za-z]{2})\b", 1))
    return F.when(found != "", found)


def link_suffix(text: Column) -> Column:
    """The language hint (``url_parts``) of the first address in the text, or null."""
    found = url_parts(F.regexp_extract(text, r"https?://[^\s\"'<>]+", 0))[1]
    return F.when(found != "", found)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    langs: tuple[str, ...] = LANGS,
    strength: float = 20.0,
    least: float = 0.6,
) -> DataFrame:
    """One row per document: doc_id, declared, suffix, host, text_lang, lang, posterior, rejected.

    ``declared``, ``suffix`` and ``host`` are columns of ``docs`` (null: no such
    evidence).  A document is rejected if it has no letters, if ``und`` wins or
    if the best posterior is below ``least``; null and empty texts are rejected.
    Repeated rows get equal results, texts have any length, an empty table gives
    an empty result, other columns are ignored.
    """
    none = F.lit(None).cast("string")
    given = lambda c: none if c is None else F.lower(c)
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.substring(given(declared), 1, 2).alias("declared"),
        given(suffix).alias("suffix"),
        (F.lit("") if host is None else F.coalesce(host, F.lit(""))).alias("host"),
        F.col(text_col).alias("text"),
    )
    classes = [*langs, "und"]
    rows = text_evidence(plain, learn(plain, langs))
    best = F.array_position(F.col("ll"), F.array_max("ll")).cast("int")
    known = lambda c: F.when(F.col(c).isin(*langs), F.col(c)).when(F.col(c).isNull() | (F.col(c) == ""), "none").otherwise("other")
    rows = cut(
        rows.withColumn("text_lang", F.when(F.col("letters") == 0, "und").otherwise(F.element_at(F.array(*map(F.lit, classes)), best)))
        .withColumn("_declared", known("declared"))
        .withColumn("_suffix", known("suffix"))
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]+)$", 1))
    )

    def channel(c: str) -> list[Column]:
        """log P(value | class), counted with one pseudo-document a value; columns are language or 'other'."""
        count = {(r[0], r[1]): r.n for r in rows.groupBy("text_lang", c).agg(F.count("*").alias("n")).collect()}  # classes * (languages + 2)
        values = [*langs, "other"]
        out = []
        for k in classes:
            own = {v: count.get((k, v), 0) + 1.0 + (4.0 if v == k else 0.0) for v in values}
            all_ = sum(own.values())
            logs = F.create_map(*[x for v in values for x in (F.lit(v), F.lit(float(np.log(own[v] / all_))))])
            out.append(F.when(F.col(c) == "none", 0.0).otherwise(logs[F.col(c)]))
        return out

    counts = [F.sum(F.when(F.col("text_lang") == k, 1.0).otherwise(0.0)).alias(f"n{i}") for i, k in enumerate(classes)]
    hosts = rows.groupBy("host", "domain").agg(*counts)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(classes))])
    whole = domains.agg(*[F.sum(f"d{i}") for i in range(len(classes))]).first()
    share = [(float(x or 0) + 1) / (sum(float(y or 0) for y in whole) + len(classes)) for x in whole]
    size = lambda p: sum((F.col(f"{p}{i}") for i in range(1, len(classes))), F.col(f"{p}0"))
    priors = hosts.join(domains, "domain")
    up = [(F.col(f"d{i}") + strength * share[i]) / (size("d") + strength) for i in range(len(classes))]
    priors = priors.select("host", *[((F.col(f"n{i}") + strength * up[i]) / (size("n") + strength)).alias(f"p{i}") for i in range(len(classes))])
    found = salted_lookup(rows, priors, ["host"], F.col("doc_id"), 32)
    said, ends = channel("_declared"), channel("_suffix")
    score = [F.element_at("ll", i + 1) + said[i] + ends[i] + F.log(F.col(f"p{i}")) for i in range(len(classes))]
    found = found.withColumn("score", F.array(*score)).withColumn("top", F.array_max("score"))
    sure = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    won = F.element_at(F.array(*map(F.lit, classes)), F.array_position("score", F.col("top")).cast("int"))
    won = F.when(F.col("letters") == 0, "und").otherwise(won)
    return found.select(
        "doc_id", "declared", "suffix", "host", "text_lang", won.alias("lang"), sure.alias("posterior"), ((won == "und") | (sure < least)).alias("rejected")
    )
