"""Added spans: planted ones are found, clean text is left alone, the vote model equals a plain one."""

from __future__ import annotations

import math

import numpy as np
import pytest

from framewright.llm import pii

TOKEN = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
PLANTED = {
    "secret": [f'set token = "{TOKEN}" here', "API_KEY: sk9Qz7Lm2Xw8Rt4Vb6Nc1Yd3", "send Bearer 7f3a9c1e5b8d2f4a6c0e9b7d to it", 'Passwort = "h7Gt5Rf4Ed3Ws2Qa1Zx9Cv8"'],
    "place": ["he lives at 221 Baker Street today", "wohnt Gartenstraße 12 im Ort", "vive en la calle de Alcalá 45 hoy", "habite 12 rue de Rivoli ici"],
    "name": ["Regards, Dr. Elena Fischer", "contact Robert van Dyke now", "Dear Mrs. Mary Walker and all"],
    "phone": ["call (212) 555-0143 today"],
    "email": ["write to jane.doe (at) example (dot) com soon"],
}
CLEAN = [
    f"commit {TOKEN} was merged", f'sha1: "{TOKEN}"', "the Street was long and the Mark was high", "in 2024 there were 15 of them",
    "James walked home", "https://example.com/a-long-path-2020/of-many-words-and-more", "supercalifragilisticexpialidocious", "Bridge Street",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for own in PLANTED.values() for t in own] * 5 + CLEAN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, {r.doc_id: r for r in pii.find_pii(docs).collect()}


def test_planted_spans_are_added(found):
    texts, rows = found
    wanted = {t: kind for kind, own in PLANTED.items() for t in own}
    for i, t in enumerate(texts):
        if t in wanted:
            assert wanted[t] in [s.split(":")[0] for s in rows[i].spans.split(",")], t
            assert rows[i].n_added >= 1 and (rows[i].n_email, rows[i].n_phone) == (0, 0)


def test_clean_text_is_left_alone(found):
    texts, rows = found
    for i, t in enumerate(texts):
        if t in CLEAN:
            assert rows[i].spans == "", t


def test_the_token_s_span_is_exact(found):
    texts, rows = found
    at = texts[0].index(TOKEN)
    assert rows[0].spans == f"secret:{at}:{at + 40}"


def test_tokens_of_the_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = docs.where("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count()
    assert wanted > 0
    assert pii.find_pii(docs).where("spans like '%secret:%'").count() == wanted


def _plain_em(rows, kind, rounds):
    """Expectation-maximisation over single spans, by loops."""
    spans = [[v // 3**j % 3 for j in range(5)] for k, v, _, n in rows if k == kind for _ in range(n)]
    p = [1 / (1 + math.exp(-1.5 * sum(v - 1 for v in s) + 1.5)) for s in spans]
    for _ in range(rounds):
        prior = (sum(p) + 1) / (len(p) + 2)
        trust = []
        for truth, lean in ((0, (4, 2, 1)), (1, (1, 2, 4))):
            own = []
            for j in range(5):
                c = [lean[v] + sum(q if truth else 1 - q for q, s in zip(p, spans) if s[j] == v) for v in range(3)]
                own.append([x / sum(c) for x in c])
            trust.append(own)
        odds = [math.log(prior / (1 - prior)) + sum(math.log(trust[1][j][s[j]] / trust[0][j][s[j]]) for j in range(5)) for s in spans]
        p = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    return trust


def test_vote_model_equals_a_plain_one():
    rng = np.random.default_rng(5)
    votes = sorted(set(rng.integers(0, 243, 25).tolist()))
    rows = [(k, v, int(rng.integers(0, 1024)), int(rng.integers(1, 9))) for k in (0, 4) for v in votes]
    trust, _ = pii.fit(rows, rounds=12)
    for k in (0, 4):
        assert np.allclose(trust[k], np.array(_plain_em(rows, k, 12)), atol=1e-9)


def test_texts_without_digits_and_long_runs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A" * 300_000), (4, "a1" * 200_000), (5, "Dr. " * 50_000), (6, "1 Aa " * 50_000)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert len(rows) == 6 and rows[1] == rows[2] == rows[3] == rows[5] == ""
    assert pii.find_pii(docs.limit(0)).count() == 0
