import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import exact_dedup, flac, language, line_dedup, mixing, ngram_join, packing, pii, quality, sharding, store
from framewright.llm.queries import word_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in rows], SCHEMA)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
BASE = " ".join(f"base{i}" for i in range(60))
EDGE = [(1, None), (2, ""), (3, "Hello World again and again"), (4, "hello world AGAIN and again"), (5, "é" * 10), (5, "é" * 10), (6, LONG), (7, BASE), (8, BASE + " tail"), (9, " \t\n ")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_groups(edge):
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[low(t)].append(i)
    want = sorted((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)
    got = exact_dedup.exact_groups(edge).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, got.collect())) == want
    assert exact_dedup.exact_groups(edge.limit(0)).count() == 0


def test_sharding(edge):
    got = sharding.shard_rows(edge, 3).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in EDGE)
    assert sorted(r.row_no for r in got) == list(range(len(EDGE)))
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all({r.slot for r in got if r.shard == s} == set(range(n)) for s, n in shards.items())
    assert sharding.shard_rows(edge.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation_inverts(spark, n):
    df = spark.range(n).select("id", sharding.permute(F.col("id"), n, 3).alias("p"))
    df = df.select("id", "p", sharding.permute(F.col("p"), n, 3, inverse=True).alias("back"))
    rows = df.collect()
    assert {r.p for r in rows} == set(range(n)) and all(r.id == r.back for r in rows)


def test_flac_round_trip(edge):
    media = flac.flac_encode(edge)
    got = {}
    for r in flac.pcm_blocks(media).collect():
        got.setdefault(r.doc_id, {})[r.sample_offset] = bytes(r.pcm)
    for i, t in dict(EDGE).items():
        raw = b"".join(got[i][k] for k in sorted(got[i])) if i != 5 else None
        assert raw is None or raw.translate(flac._FLIP) == flac.payload((t or "").encode())
    assert flac.read_back(media).count() == len(EDGE) and flac.read_back(flac.flac_encode(edge.limit(0))).count() == 0


def test_flac_finds_damage():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), bytes(rng.integers(0, 256, 4096, np.uint8)), b"abc " * 800]
    media = flac.encode(payloads)
    assert flac.decode(media)[0] == payloads
    for at in (len(media[2]) // 2, len(media[2]) - 1, 30):
        bad = bytearray(media[2])
        bad[at] ^= 1
        with pytest.raises(flac.CorruptMedia):
            flac.decode([bytes(bad)])


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    group = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {i: (len(s), group[i]) for i, s in sets.items()}


def test_near_groups(edge):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(edge).collect()}
    want = brute_groups(EDGE)
    assert got == want
    assert ngram_join.near_groups(edge.limit(0)).count() == 0


def test_keys_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, n // 4) + 1))):
            b = np.unique(np.append(np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else b, rng.integers(0, 2**64, 1, np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            keys = [set(ngram_join.signature_keys(s, np.array([len(s)]))[1].tolist()) for s in (a, b)]
            assert keys[0] & keys[1], (len(a), len(b), both)


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{line}\nunique one two three four five six"), (2, f"{line.upper()}!!\nshort line"), (3, f"short line\n{line}"), (4, None), (5, "")]
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs_of(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "short line" and got[3].text == ""
    assert (got[2].n_lines, got[2].n_dropped, got[4].text, got[5].text) == (2, 1, None, "")
    assert "node" in got[1] and line_dedup.drop_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_mixing_meets_its_targets(documents):
    got = mixing.mix(documents).toPandas()
    assert len(got) == documents.count() and got.probability.between(0, 1).all()
    got["w"] = got.tokens * got.factor
    for m in mixing.MARGINS:
        seen = got.groupby(m).tokens.sum() ** 0.95
        now = got.groupby(m).w.sum()
        assert np.allclose(now / now.sum(), seen / seen.sum(), atol=1e-6)


def test_raking_in_spark_equals_the_driver(documents):
    small = documents.where("doc_id < 40").select("source", "lang", F.lit("t").alias("topic"), F.length("text").cast("long").alias("tokens"))
    cells = store.cut(small.groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens")))
    targets = {m: mixing.tempered(cells, m, 0.9) for m in mixing.MARGINS}
    a, b = (mixing.rake(cells, targets, rounds=2, driver_cells=n).toPandas().sort_values(list(mixing.MARGINS)).factor.to_numpy() for n in (1000, 0))
    assert np.allclose(a, b)


def test_language(documents, edge):
    got = language.identify(documents, declared=F.col("lang"), host=F.col("source"))
    right = documents.withColumnRenamed("lang", "want").join(got, "doc_id").where("want = lang").count()
    assert right >= 0.98 * documents.count()
    odd = {r.doc_id: r.rejected for r in language.identify(edge, declared=F.col("lang")).collect()}
    assert odd[1] and odd[2] and odd[9]


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("doc_id", "text", "quality")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    got = quality.score(docs, quality.fit(docs, rows.where(fold != 0))).join(rows.where(fold == 0), "doc_id").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() >= 0.9


def test_quality_of_odd_texts(edge):
    model = quality.QualityModel(b"good", b"bad", np.zeros(5))
    assert [r.score for r in quality.score(edge, model).collect()] == [0.5] * len(EDGE)


def test_packing(edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    got = packing.pack_documents(edge, word_tokenizer(), 256).collect()
    for i, t in dict(EDGE).items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert own == [(k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 256
    assert packing.pack_documents(edge.limit(0), word_tokenizer()).count() == 0


def test_plan_is_best_fit():
    counts = {4: 10, 3: 5, 2: 7, 1: 3}
    plan = packing.plan_best_fit(counts, 8)
    assert {n: sum(t - f for length, f, t, *_ in plan if length == n) for n in counts} == counts
    used = {first + i for _, f, t, first, each, _ in plan for i in range((t - f) // each)}
    assert len(used) == -(-sum(k * v for k, v in counts.items()) // 8)


TEXTS = ["mail a.b+c@x-y.org.uk, @no, me@host", "ip 1.2.3.4.5 and 300.1.1.1", "4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (743) 555-3824.", "a@b.c@d.e", ""]


def test_base_spans_follow_the_patterns():
    for text in TEXTS:
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                want.append((2, *m.span()))
        want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert sorted(pii.spans_of(text)[0]) == sorted(want)


def test_candidates_inside_long_base_spans_are_not_free():
    text = "a@b.c.1.2.3.4.x5.6.7.8.y1.1.1.1.z2.2.2.2.w3.3.3.3.q4111111111111112 end"
    base, rest = pii.spans_of(text)
    assert len(base) > 5 and not any(k == 2 for k, _, _ in rest)
    assert pii.spans_of("mail a@b.cd then 4111111111111112")[1] == [(2, 17, 33)]


def test_pii_table(spark, edge):
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, enumerate([*TEXTS, None]))).collect()}
    assert got[3].n_phone == 1 and got[3].spans == "phone:5:22" and got[6].spans == ""
    assert pii.find_pii(edge).count() == len(EDGE) and pii.find_pii(edge.limit(0)).count() == 0


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, words, n):
    words = list(words)
    for k in range(n):
        at = int(rng.integers(len(words)))
        words[at : at + int(rng.integers(0, 2))] = [f"new{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}"] * int(rng.integers(0, 2))
    return words


def test_edited_lines_are_all_found(spark):
    rng = np.random.default_rng(3)
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(3000)]
    lines = []
    for n in (4, 5, 6, 8, 9, 10, 12, 14, 19, 20, 24, 30, 40, 60, 100):
        for share in (0.01, 0.05, 0.1, 0.15, 0.2):
            for _ in range(3):
                base = [names[int(i)] for i in rng.integers(0, len(names), n)]
                lines += [base, edited(rng, base, max(1, int(n * share)))]
    lines = [x for x in lines if x]
    want = {}
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            most = max(len(x), len(y)) // 5
            if abs(len(x) - len(y)) <= most and sum((Counter(x) & Counter(y)).values()) >= max(len(x), len(y)) - most and word_edits(x, y) <= most:
                want.setdefault(i, j)
    assert len(want) > 120
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_lines(docs_of(spark, [(i, " ".join(x)) for i, x in enumerate(lines)])).collect()}
    assert not any(n for i, n in got.items() if i not in want)
    short = [i for i in want if len(lines[i]) <= line_dedup.SHORT and len(lines[want[i]]) <= line_dedup.SHORT]
    assert all(got[i] for i in short) and sum(got[i] for i in want) >= 0.93 * len(want)


def test_lines_of_large_keys(spark, monkeypatch):
    """Copies of one line at every distance round the threshold share their keys."""
    monkeypatch.setattr(line_dedup, "FEW", 6)
    monkeypatch.setattr(line_dedup, "LEADERS", 2)
    rng = np.random.default_rng(9)
    base = ["".join("klmnopqrst"[int(d)] for d in f"{i:03d}") for i in range(20)] + ["zzzzzzzzzzzz", "yyyyyyyyyyyy"]
    lines = []
    for k in range(40):
        words = list(base)
        for at in rng.choice(20, int(rng.integers(0, 6)), replace=False):
            words[at] = "".join("abcdefghij"[int(d)] for d in f"{k:02d}{at:02d}")
        lines.append(words)
    group = list(range(40))
    for i in range(40):
        for j in range(i):
            if word_edits(lines[i], lines[j]) <= 22 // 5 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_lines(docs_of(spark, [(i, " ".join(x)) for i, x in enumerate(lines)])).collect()}
    assert got == {i: int(g != i) for i, g in enumerate(group)} and 0 < sum(got.values()) < 40


def test_simhash_would_lose_most_alike_lines():
    """Why candidates aren't SimHash blocks: lines with a fifth of their words replaced are too far apart for any usable blocks."""
    rng = np.random.default_rng(2)
    far = []
    for n in (8, 15, 30, 60):
        for _ in range(50):
            own = rng.integers(0, 2, (n, 64)) * 2 - 1
            new = own.copy()
            new[: n // 5] = rng.integers(0, 2, (n // 5, 64)) * 2 - 1
            far.append(int(((own.sum(0) > 0) != (new.sum(0) > 0)).sum()))
    assert np.median(far) > 8


@pytest.mark.parametrize("name", ["_fw", "n_dropped", "key", "node", "gone"])
def test_lines_with_clashing_columns(spark, name):
    rows = [(1, "one two three four\nfive", "q"), (2, "One two three four!\nsix", "q"), (None, "six", "q"), (2, None, "q")]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, f"doc_id long, text string, {name} string"))
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == sorted(map(str, [(1, rows[0][1], 2, 0), (2, "six", 2, 1), (None, "six", 1, 0), (2, None, 0, 1)]))
    assert len(set(got.columns)) == len(got.columns)


def test_short_copies_go_in_the_query_and_the_pipeline(spark, tmp_path):
    import corpus_pipeline
    from framewright.llm import queries

    rows = [(1, "All rights reserved\n12\n\nfirst text"), (2, "all rights RESERVED.\n12\n\nsecond text"), (3, "Menu"), (4, "menu!")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (4, 1), 3: (1, 0), 4: (1, 1)}
    left = {r.doc_id: r.text for r in corpus_pipeline.unique_lines(spark, docs_of(spark, rows), "").collect()}
    assert left == {1: rows[0][1], 2: "12\n\nsecond text", 3: "Menu"}
