import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from framewright.llm import cutting_stock, phrases, queries, spelling
from framewright.llm.store import Scratch

KIND = "doc_id long, text string, lang string, word string, key long, fp long, part int, n long"
ODD = [(1, None, None, "a", 1, 2, 3, 4), (None, "", "en", "b", 1, 2, 3, 4), (3, " .\n\x0b", "de", None, None, None, None, None)]


def odd(spark, rows=()):
    """Rows with nulls, empty texts, repeats and columns named like the operators' own."""
    filled = [(i, t, lang, "w", 1, 2, 3, 4) for i, t, lang in rows]
    return spark.createDataFrame(ODD + filled + filled[:1], KIND)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


# spelling


@pytest.mark.parametrize("long_list", [spelling.LONG_LIST, 2])
def test_near_words_equal_brute_force(spark, long_list):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 14))) for _ in range(300)}
    for w in list(words):
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]}
    words = {w for w in words if len(w) >= 6} | {"x" * 400, "x" * 399 + "y"}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_pairs(df, Scratch(), long_list).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if one_edit(*p)}


def test_affected_grams_bound_every_edit():
    rng = random.Random(9)
    frequent = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))): 9 for _ in range(40)}
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(6, 15)))
        longest = spelling.longest_gram(len(word) - 1) if len(word) > 6 else 3
        grams = spelling.decompose(word, longest, frequent)
        bound = spelling.affected(word, grams, longest, frequent)
        assert bound < len(grams)
        i = rng.randrange(len(word) + 1)
        for other in (word[:i] + "a" + word[i:], word[:i] + "b" + word[i + 1 :], word[:i] + word[i + 1 :]):
            if len(other) >= 2 * longest:
                left = Counter(word[a:b] for a, b in grams)
                left -= Counter(other[a:b] for a, b in spelling.decompose(other, longest, frequent))
                assert left.total() <= bound


def test_variants_of_odd_rows(spark):
    texts = ["Colour " * 60 + "colouR, color" + " colr" * 5, "color " * 6 + "naïveté " * 5 + "NAÏVETÉ" + " naivete" * 5, "short " * 9]
    docs = odd(spark, [(10 + i, t, "en") for i, t in enumerate(texts)])
    runs = Counter()
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), r.text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            runs[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    assert {r.word: r.n for r in spelling.count_words(docs, every=3).collect()} == dict(runs)
    got = {r.word: r for r in spelling.variants(docs, letters=5).collect()}
    assert got["color"][1:] == ("colour", "colour", got["color"].n, 1, got["colour"].n) and got["colour"].form is None and got["colour"].form_n is None
    assert got["naïveté"].root == "naïveté"
    assert spelling.variants(docs.limit(0)).count() == 0


def test_roots_follow_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(chain, Scratch()).collect()} == {f"w{i}": "w9" for i in range(9)}


# phrases


def want_phrases(rows, least, best):
    pieces = [(lang or "und", re.findall(r"[^ \t]+", p)) for _, t, lang in rows for p in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    f = Counter((lang, tuple(ws[i : i + k])) for lang, ws in pieces for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    n = Counter()
    for lang, ws in pieces:
        n[lang] += len(ws)
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least or (len(p) == 2 and any(100 * b >= 50 * a for (m, q), b in f.items() if m == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:]))):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best]))


@pytest.mark.parametrize("primes", [phrases.PRIMES, (31, 29)])
def test_collocations_equal_brute_force(spark, primes):
    """With small primes most fingerprints are shared, and all is counted by text."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["New", "york", "city", "aé", "b"]) + rng.choice([" ", " ", " ", "\t", ", ", "\n"]) for _ in range(150)) for _ in range(6)]
    docs = odd(spark, [(10 + i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)])
    got = phrases.collocations(docs, least=4, best=9, primes=primes)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, got.collect())) == want_phrases(rows, 4, 9)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    rows = spark.createDataFrame([("a b", 2, 10_000_000_000), ("a", 1, 10_000_000_000), ("b", 1, 30_000_000_000)], "phrase string, k int, n long")
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    kept = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *a: (rows.selectExpr("'en' AS lang", "*"), spark.createDataFrame([("en", 7)], "lang string, n long"))
    try:
        assert [r.score for r in phrases.collocations(docs).collect()] == [333_333]
    finally:
        phrases.frequent_phrases = kept


def test_bloom_filter_has_every_key(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS fp")
    bits = phrases.bloom_filter(keys, 5000, 1 << 12).value
    assert len(bits) == 512 and phrases.in_bloom(bits, np.array([r.fp for r in keys.collect()])).all()
    wide = phrases.bloom_filter(keys, 5000).value
    other = np.array([r.fp for r in spark.range(5000, 9000).selectExpr("xxhash64(id) AS fp").collect()])
    assert phrases.in_bloom(wide, other).mean() < 0.02


def test_collocations_equal_sql(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(db.sql(queries.ORACLE_SQL["op12_phrases"]).fetchall())
    assert sorted(map(tuple, queries.op12_phrases(spark, "/root/testdata/sf0.001").collect())) == want and want


# cutting stock


def test_prices_and_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        value = np.concatenate([[0], rng.random(12)])
        best, counts = cutting_stock.price_pattern(value, 12)
        table = [0.0] * 13
        for room in range(1, 13):
            table[room] = max([table[room - 1], *(value[c] + table[room - c] for c in range(1, room + 1))])
        assert abs(best - table[12]) < 1e-12 and abs(value @ counts - best) < 1e-12 and counts @ np.arange(13) <= 12
    columns, uses, bound = cutting_stock.solve_patterns({6: 100, 4: 100, 5: 40, 3: 7}, 10)
    made = Counter()
    for p, u in zip(columns, uses, strict=True):
        assert sum(c * k for c, k in p.items()) <= 10
        for c, k in p.items():
            made[c] += u * k
    assert all(made[c] >= n * (1 - 1e-6) for c, n in {6: 100, 4: 100, 5: 40, 3: 7}.items())
    assert bound <= sum(uses) * (1 + 1e-9) <= 1.001 * bound and abs(sum(uses) - 122 - 1 / 3) < 1e-5  # 100 of 6 + 4, 20 of 5 + 5, 7 / 3 of 3 + 3 + 3


def test_every_id_lies_in_one_piece_without_padding(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma9", "é!"]) for _ in range(rng.choice([1, 5, 40, 90, 700]))) for _ in range(120)]
    docs = odd(spark, [(10 + i, t, "en") for i, t in enumerate(texts)])
    got = cutting_stock.pack_cutting(docs, queries.word_tokenizer(), limit=128, width=8).toPandas()
    tok = Tokenizer.from_file(queries.word_tokenizer())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got.length.sum() == want.total() and set(got.doc_id.dropna()) == {i for i, _ in rows if i is not None}
    of = dict(rows)
    for r in got[got.doc_id != 10].dropna().itertuples():  # 10 is there twice
        ids = np.array([*tok.encode(of[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for i, g in got.dropna().groupby("doc_id"):
        each = g.sort_values(["start", "length"])
        assert i == 10 or (each.length.cumsum() - each.length == each.start).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = g.length.sum()
        assert (g.length.cumsum() - g.length == g.offset).all() and total <= 128 and total & (total - 1) == 0
    assert got.groupby("sequence_id").length.sum().value_counts().drop(128).max() == 1
    assert cutting_stock.pack_cutting(docs.limit(0), queries.word_tokenizer()).count() == 0
