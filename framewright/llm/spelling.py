"""Spelling variants grouped by an index of variable-length grams.

Words are counted over the whole corpus.  A gram is frequent when it occurs more
often than a threshold that keeps the dictionary of frequent grams under
``DICTIONARY`` entries.  A word is decomposed from each of its places: the gram
starts with two letters and grows while it is frequent, so common beginnings
become long grams; grams inside an earlier one are left out.

One edit changes a bounded number of a word's grams, counted for each word (the
largest number over all its edits).  A word with ``b`` such grams therefore
shares one of its ``b + 1`` rarest with every near word, at the same distance
from the left end or from the right end: those are the lists that are joined.
Pairs found are verified by their edit distance.

Grams are at most half as long as the shorter word of a pair, which leaves at
least one gram untouched by any edit, so that no pair is lost.  Lists of over
``LONG_LIST`` words are split by one-deletion neighbours, also without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

RUN = "[A-Za-zÀ-ÿ]+"
#: Frequent grams kept at most; the table sent to the tasks is bounded by this.
DICTIONARY = 200_000
SHORTEST, LONGEST = 2, 6
LONG_LIST = 256
_KEPT = 300_000


def _spoil(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; one in ``every`` by checksum lacks a letter."""

    def run(batches: Iterator) -> Iterator:
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        find, upper = re.compile(RUN).findall, {c: c + 32 for c in range(65, 91)}
        known: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])
            known.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, text = zlib.crc32(f"{'' if doc is None else doc}:".encode()), text or ""
                for w, n in Counter(find(text.lower() if text.isascii() else text.translate(upper))).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % every == 0:
                        w = _spoil(w, h)
                    known[w] = known.get(w, 0) + n
                if len(known) > _KEPT:
                    yield flush()
        yield flush()

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def longest_gram(shorter: int) -> int:
    """Grams of pairs whose shorter word has so many letters."""
    return min(LONGEST, shorter // 2)


def frequent_grams(words: DataFrame, entries: int = DICTIONARY) -> dict[str, int]:
    """Grams of 2 to LONGEST - 1 letters that occur more than (all grams / entries) times: fewer than ``entries``."""
    grams = words.select(
        F.explode(
            F.expr(
                f"flatten(transform(sequence({SHORTEST}, {LONGEST - 1}), q -> transform(sequence(1, greatest(1, length(word) - q + 1)), i -> substring(word, i, q))))"
            )
        ).alias("gram")
    )
    each = " + ".join(f"greatest(1, length(word) - {q} + 1)" for q in range(SHORTEST, LONGEST))
    total = words.agg(F.sum(F.expr(each))).first()[0] or 0
    kept = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > max(8, total / entries))
    return {r.gram: r.n for r in kept.collect()}


def decompose(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the word's grams, ends exclusive; grams that end inside or with an earlier one are left out."""
    out, reach = [], 0
    for at in range(len(word) - SHORTEST + 1):
        to = at + SHORTEST
        while to < len(word) and to - at < longest and word[at:to] in frequent:
            to += 1
        if to > reach:
            out.append((at, to))
            reach = to
    return out


def affected(word: str, grams: list[tuple[int, int]], longest: int, frequent: dict[str, int]) -> int:
    """The most grams that one edit can take from the word.

    A gram's end is decided by its own letters.  So an edit leaves the grams
    that end before it, but for one that ends with the word and would go on;
    of those that start after it, a gram can only be covered by one that takes
    in the edited place, which reaches less than ``longest`` letters on.
    """
    size, most = len(word), 0
    for i in range(size + 1):
        # a letter put in before place i
        put = sum(
            1
            for a, b in grams
            if (a < i < b) or (a >= i and b - i + 1 <= longest) or (i == size == b and b - a < longest and word[a:b] in frequent)
        )
        # place i changed or taken out
        cut = sum(1 for a, b in grams if a <= i < b or (a > i and b - i <= longest)) if i < size else 0
        most = max(most, put, cut)
    return most


def gram_keys(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(shorter, gram, side, away, word, n): the lists each word stands in."""
    table = words.sparkSession.sparkContext.broadcast(frequent)  # under DICTIONARY grams

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common = table.value
        names = ("shorter", "gram", "side", "away", "word", "n")
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made: dict[int, list] = {}
                for shorter in (len(word), len(word) - 1):
                    longest = longest_gram(shorter)
                    if longest < SHORTEST:
                        continue
                    if longest not in made:
                        grams = decompose(word, longest, common)
                        rare = sorted(grams, key=lambda g: (common.get(word[g[0] : g[1]], 0), g[0] - g[1], word[g[0] : g[1]], g[0]))
                        made[longest] = rare[: affected(word, grams, longest, common) + 1]
                    for a, b in made[longest]:
                        for side, away in ((0, a), (1, len(word) - a)):
                            for col, v in zip(rows, (shorter, word[a:b], side, away, word, n), strict=True):
                                col.append(v)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], list(names))

    return words.select("word", "n").mapInArrow(run, "shorter int, gram string, side int, away int, word string, n long")


LIST = ["shorter", "gram", "side", "away"]


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (word below other) in the same list that are one edit apart."""
    other = rows.select(*keys, F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (F.col("word") < F.col("other")) & (F.least(F.length("word"), F.length("other")) == F.col("shorter"))
    return rows.join(other, keys).where(near).where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, store: Scratch, long_list: int = LONG_LIST) -> DataFrame:
    """All pairs of words one edit apart, each once: (word, n, other, other_n)."""
    keys = store.cut(gram_keys(words, frequent_grams(words)))
    sizes = store.cut(keys.groupBy(*LIST).agg(F.count("*").alias("size")).where("size > 1"))
    short = keys.join(sizes.where(F.col("size") <= long_list), LIST, "left_semi")
    found = _pairs(short, LIST)
    long = keys.join(sizes.where(F.col("size") > long_list), LIST, "left_semi")
    # equal words without one letter each, or the one word without a letter being the other
    without = F.expr("array_distinct(array_append(transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))), word))")
    split = long.select("shorter", "word", "n").distinct().select("shorter", "word", "n", F.explode(without).alias("part"))
    found = found.unionByName(_pairs(split, ["shorter", "part"]))
    return found.distinct()


def _roots(forms: DataFrame, store: Scratch) -> DataFrame:
    """(word, root): chains of forms followed to their ends by doubling, until none goes on."""
    now = store.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = store.cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text", store: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``letters`` letters and ``least`` occurrences.

    Near words differ by one inserted, deleted or replaced letter.  A word's
    form is its near word of largest count (ties: smallest), if that is at
    least ``times`` the word's own; its root is the end of the chain of forms.
    Null texts have no words, a null id counts as an empty one; an empty table
    gives an empty result; repeated rows count each; other columns are ignored.
    A word may be of any length.
    """
    if letters < 2 * SHORTEST:
        raise ValueError(f"words need at least {2 * SHORTEST} letters")
    store = store or Scratch()
    words = count_words(docs, id_col, text_col).where((F.length("word") >= letters) & (F.col("n") >= least))
    words = store.cut(words)
    pairs = store.cut(near_pairs(words, store))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("top"))
    top = both.join(best, "word").where(F.col("other_n") == F.col("top")).groupBy("word", "n_near", "top").agg(F.min("other").alias("form"))
    known = words.join(top, "word", "left")
    is_form = F.col("top") >= times * F.col("n")
    known = store.cut(
        known.select(
            "word",
            F.when(is_form, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form IS NOT NULL"), store)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
