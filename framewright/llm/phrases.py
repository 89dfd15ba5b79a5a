"""Collocations mined with Rabin-Karp fingerprints.

A word is a 64-bit number of its bytes; prefix polynomials over a text's words,
modulo two primes, give the fingerprint of every run of words in numpy.  A task
adds equal fingerprints up before they are shuffled; a fingerprint travels with
its count, a checksum that is computed in another way, and a pointer to a
document that has it.

Words and pairs come first.  Longer runs are sent only where both runs one word
shorter are in a Bloom filter of the frequent ones: it has no false negatives,
and its size is bounded, so at worst more is shuffled.

Frequent fingerprints are looked up in the documents they point to, which gives
their texts.  Where checksums of one fingerprint differ, different phrases
share it; those are counted anew by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, salted_lookup

#: Primes below 2**31 and the bases of the polynomials.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
#: A Bloom filter has at most this many bits (32 MB).
MOST_BITS = 1 << 28
BLOOM_HASHES = 4
#: Runs of words that a task gathers before it adds equal ones up.
GATHERED = 1_500_000
_FOUND = "fp long, n long, check int, place int"


def _powers(base: int, prime: int, n: int):
    """base ** 0 .. base ** (n - 1) modulo prime, by doubling."""
    import numpy as np

    out, have = np.ones(max(1, n), np.uint64), 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += take
    return out


class Runs:
    """Words of some texts and the fingerprints of all their runs."""

    def __init__(self, texts: list[bytes], langs, primes: tuple[int, int]) -> None:
        import numpy as np

        from .shingles import Spans

        kind = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
        kind[[32, 9]] = 1
        kind[[*b".,;:!?", 10, 11, 12, 13]] = 2
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        sort = kind[data]
        word = np.concatenate([[False], sort == 0, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(sort == 2)[self.start] if len(self.start) else self.start
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(begins, self.start, side="right") - 1
        self.lang = np.asarray(langs, np.int64).view(np.uint64)[self.doc] if len(self.doc) else np.zeros(0, np.uint64)
        self.spans = Spans(data, self.start, self.end)
        self.words, self.primes = self.spans.hashes(), primes
        self.prefix = []
        for prime, base in zip(primes, BASES, strict=True):
            p, n = np.uint64(prime), len(self.words)
            power = _powers(base, prime, n)
            sums = np.cumsum(self.words % p * power % p)  # under 2**31 each, so a sum of 2**33 words fits
            self.prefix.append((np.concatenate([np.zeros(1, np.uint64), sums % p]), _powers(pow(base, -1, prime), prime, n)))

    def at(self, k: int):
        """First words of the runs of ``k`` words inside a piece."""
        import numpy as np

        n = len(self.words) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def fingerprints(self, at, k: int):
        """(fingerprints, checksums) of the runs of ``k`` words that begin at ``at``."""
        import numpy as np

        from .shingles import _COEF, mix

        both = np.zeros(len(at), np.uint64)
        for prime, (sums, back) in zip(self.primes, self.prefix, strict=True):
            p = np.uint64(prime)
            both = (both << np.uint64(32)) | ((sums[at + k] + p - sums[at]) % p * back[at] % p)
        key = mix(both * np.uint64(2) + np.uint64(1) ^ mix(self.lang[at] + np.uint64(k)))
        check = np.zeros(len(at), np.uint64)
        for i in range(k):
            check = mix(check + self.words[at + i] * _COEF[i])
        return key.view(np.int64), (check >> np.uint64(33)).astype(np.int32)

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.spans.bytes(i) for i in range(at, at + k)).decode()


def all_words(lang):
    """Fingerprint of the count of a language's words."""
    import numpy as np

    from .shingles import mix

    return mix(np.asarray(lang, np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def prepared(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """(lang, lang_key, place, text); the few rows that share a ``place`` are all looked at."""
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(lang.alias("lang"), F.xxhash64(lang, F.lit("lang")).alias("lang_key"), F.hash(F.col(id_col), text, lang).alias("place"), text.alias("text"))


def _slices(batch, lang: int, text: int):
    from .shingles import as_bytes, in_slices

    texts, langs = as_bytes(batch.column(text)), batch.column(lang).to_pylist()
    for a, b in in_slices(texts):
        yield a, b, texts[a:b], langs[a:b]


def _added_up(parts: list):
    """Rows of equal fingerprint and checksum as one: (fp, n, check, place); ``parts`` is emptied."""
    import numpy as np

    cols = [np.concatenate([p[i] for p in parts]) for i in range(4)]
    parts.clear()
    order = np.argsort(cols[0], kind="stable")
    cols = [c[order] for c in cols]
    same = cols[0][1:] == cols[0][:-1]
    if (same & (cols[2][1:] != cols[2][:-1])).any():  # different phrases share a fingerprint
        order = np.lexsort((cols[2], cols[0]))
        cols = [c[order] for c in cols]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[2][1:] == cols[2][:-1])
    fp, n, check, place = cols
    if not len(fp):
        return cols
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return fp[first], np.add.reduceat(n, first), check[first], np.minimum.reduceat(place, first)


def counted(docs: DataFrame, sizes: tuple[int, ...], bloom, primes: tuple[int, int]) -> DataFrame:
    """Fingerprints of runs of ``sizes`` words with counts; with ``bloom`` only runs whose two parts are in it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parts: list = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _added_up(parts)], ["fp", "n", "check", "place"])

        for batch in batches:
            where = batch.column(1).to_numpy()
            for a, b, texts, langs in _slices(batch, 0, 2):
                runs = Runs(texts, langs, primes)
                if bloom is None:
                    each = np.bincount(runs.doc, minlength=b - a)
                    parts.append((all_words(langs), each, np.zeros(b - a, np.int32), where[a:b]))
                for k in sizes:
                    at = runs.at(k)
                    if bloom is not None:
                        known = bloom.value
                        ok = in_bloom(known, runs.fingerprints(at, k - 1)[0])
                        ok[ok] = in_bloom(known, runs.fingerprints(at[ok] + 1, k - 1)[0])
                        at = at[ok]
                    fp, check = runs.fingerprints(at, k)
                    parts.append((fp, np.ones(len(fp), np.int64), check, where[a:b][runs.doc[at]]))
                    held += len(fp)
                if held > GATHERED:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    found = docs.select("lang_key", "place", "text").mapInArrow(run, _FOUND)
    return found.groupBy("fp").agg(F.sum("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("place").alias("place"))


def _bits(fp, size: int):
    import numpy as np

    from .shingles import mix

    h = mix(fp.view(np.uint64) if fp.dtype == np.int64 else fp)
    step = mix(h ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for i in range(BLOOM_HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def in_bloom(bits, fp):
    import numpy as np

    out = np.ones(len(fp), bool)
    for at in _bits(fp, 8 * len(bits)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def bloom_filter(keys: DataFrame, n: int, most_bits: int = MOST_BITS):
    """A broadcast Bloom filter of a column of longs: 12 to 24 bits a key, ``most_bits`` at most.

    Blocks of it are made by tasks; the driver only sets them side by side.
    """
    import numpy as np

    size = min(most_bits, max(1 << 12, 1 << (12 * max(1, n)).bit_length()))
    block = min(size, 1 << 19)

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.unique(np.concatenate(list(_bits(fp, size)))) if len(fp) else np.zeros(0, np.int64)
            for b in np.unique(at // block).tolist():
                mask = np.zeros(block, np.uint8)
                mask[at[at // block == b] % block] = 1
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    def joined(block_rows):
        import pandas as pd

        out = None
        for b, bits in zip(block_rows["block"], block_rows["bits"], strict=True):
            now = np.frombuffer(bits, np.uint8)
            out = now.copy() if out is None else out | now
        return pd.DataFrame({"block": [int(b)], "bits": [out.tobytes()]})

    dealt = keys.select(keys.columns[0]).repartition(max(1, min(256, n // 500_000)))
    rows = dealt.mapInArrow(places, "block long, bits binary").groupBy("block").applyInPandas(joined, "block long, bits binary").collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:  # most_bits in all
        bits[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


_TEXTS = "fp long, lang string, phrase string, k int"


def texts_of(docs: DataFrame, wanted: DataFrame, longest: int, primes: tuple[int, int]) -> DataFrame:
    """(fp, lang, phrase, k) of the fingerprints of ``wanted`` (fp, place), looked up in the documents they point to."""
    lists = wanted.groupBy("place").agg(F.collect_list("fp").alias("fps"))  # at most the runs of one document

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import as_bytes

        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, key, lang, fps in zip(as_bytes(batch.column(0)), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                runs, fps = Runs([text], [key], primes), np.unique(np.array(fps, np.int64))
                for k in range(1, longest + 1):
                    at = runs.at(k)
                    fp, first = np.unique(runs.fingerprints(at, k)[0], return_index=True)
                    for i in np.flatnonzero(np.isin(fp, fps)).tolist():
                        for col, v in zip(rows, (int(fp[i]), lang, runs.text(int(at[first[i]]), k), k), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32())], ["fp", "lang", "phrase", "k"])

    found = docs.join(lists, "place").select("text", "lang_key", "lang", "fps").mapInArrow(run, _TEXTS)
    return found.dropDuplicates(["fp"])  # copies of a row share a place


def recounted(docs: DataFrame, shared: DataFrame, bloom, longest: int, primes: tuple[int, int]) -> DataFrame:
    """(lang, phrase, k, n) by their texts, of all phrases whose fingerprint is in ``shared`` (fp)."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = batch.column(2).to_pylist()
            for a, _, texts, langs in _slices(batch, 0, 1):
                runs, seen = Runs(texts, langs, primes), Counter()
                for k in range(1, longest + 1):
                    at = runs.at(k)
                    fp = runs.fingerprints(at, k)[0]
                    for i in np.flatnonzero(in_bloom(bloom.value, fp)).tolist():
                        seen[int(fp[i]), names[a + int(runs.doc[at[i]])], runs.text(int(at[i]), k), k] += 1
                cols = list(zip(*((*key, n) for key, n in seen.items()), strict=True)) or [[], [], [], [], []]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["fp", "lang", "phrase", "k", "n"])

    found = docs.select("lang_key", "text", "lang").mapInArrow(run, _TEXTS + ", n long").groupBy("fp", "lang", "phrase", "k").agg(F.sum("n").alias("n"))
    return found.join(shared.select("fp"), "fp", "left_semi").select("lang", "phrase", "k", "n")


def frequent_phrases(docs: DataFrame, longest: int, least: int, store: Scratch, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of every phrase of up to ``longest`` words with ``least`` occurrences, (lang, n words)); ``docs`` as ``prepared``."""
    often = F.col("n") >= least
    first = store.cut(counted(docs, (1, 2) if longest > 1 else (1,), None, primes).where(often | (F.col("low") == 0)))
    found = first.where(often)
    last = found
    for k in range(3, longest + 1):
        bloom = bloom_filter(last.select("fp"), last.count())
        last = store.cut(counted(docs, (k,), bloom, primes).where(often))
        found = found.unionByName(last)
    clean, shared = found.where("low = high").select("fp", "n", "place"), found.where("low <> high").select("fp")
    named = texts_of(docs, clean.select("fp", "place"), longest, primes)
    phrases = named.join(clean.select("fp", "n"), "fp").select("lang", "phrase", "k", "n")
    n_shared = shared.count()
    if n_shared:
        again = recounted(docs, shared, bloom_filter(shared, n_shared), longest, primes)
        phrases = phrases.unionByName(again.where(often))

    def totals(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_words(batch.column(1).to_pylist()))], ["lang", "fp"])

    langs = docs.select("lang", "lang_key").distinct().mapInArrow(totals, "lang string, fp long")
    return store.cut(phrases), langs.join(first.select("fp", "n"), "fp").select("lang", "n")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, best: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", store: Scratch | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``best`` phrases.

    A phrase's score is that of its worst cut in two, ``1000000 a a / (l r)``
    rounded down, from counts of the phrase and both parts; ties of cuts go to
    the shorter first part.  Phrases go that lie inside a longer one with at
    least half their count.  Null texts are empty, a null language is ``und``;
    repeated rows count each; texts of any length are taken whole; an empty
    table gives an empty result; other columns are ignored.
    """
    store = store or Scratch()
    ready = prepared(docs, text_col, lang_col, id_col)
    phrases, totals = frequent_phrases(ready, longest, least, store, primes)
    words = F.split("phrase", " ", -1)
    cand = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    join = lambda a, b: F.array_join(F.slice(F.col("w"), a, b), " ")
    cuts = cand.withColumn("w", words).select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("second"))
    for part, count in (("first", "l"), ("second", "r")):
        known = phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
        cuts = salted_lookup(cuts, known, ["lang", part], F.col("phrase"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.call_function("div", above.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")).cast("long")
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(worst).select("lang", "phrase", "k", "a", "m.score", "m.l", "m.r")
    # runs one word shorter carry the largest count of what they lie in down to the shortest
    inside, level = None, cand.where(F.col("k") == longest).select("lang", "phrase", "k", F.col("a").alias("top"))
    for k in range(longest, 2, -1):
        w = level.withColumn("w", words)
        sub = w.select("lang", "top", F.explode(F.array(join(F.lit(1), F.lit(k - 1)), join(F.lit(2), F.lit(k - 1)))).alias("phrase"))
        sub = sub.groupBy("lang", "phrase").agg(F.max("top").alias("top"))
        inside = sub if inside is None else inside.unionByName(sub)
        own = cand.where(F.col("k") == k - 1).select("lang", "phrase", F.col("a").alias("top"))
        level = sub.unionByName(own).groupBy("lang", "phrase").agg(F.max("top").alias("top"))
    if inside is not None:
        scored = scored.join(inside, ["lang", "phrase"], "left").where("top IS NULL OR 100 * CAST(top AS DECIMAL(20,0)) < 50 * CAST(a AS DECIMAL(20,0))")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
