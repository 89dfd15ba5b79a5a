import numpy as np

from framewright.llm import quality

from .test_operators import docs_of


def test_the_calibration_sees_whole_texts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{int(k)}" for k in rng.integers(0, 999, 8000)) for i in range(24)]
    assert min(map(len, texts)) > 40_000
    seen = []
    fitted = quality._logistic
    monkeypatch.setattr(quality, "_logistic", lambda x, y: seen.append(x) or fitted(x, y))
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    quality.fit(docs_of(spark, list(enumerate(texts))), labels)
    assert np.allclose(sorted(seen[0][:, 4]), sorted(np.log1p(len(t)) / 4 for t in texts))
