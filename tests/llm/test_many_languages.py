"""Language identification with as many languages as a dirty column may hold, against the same sums in one matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pricegrain.llm import language_id as L


def plain_weights(texts: dict[str, list[str]], code: np.ndarray) -> np.ndarray:
    counts = np.array([np.bincount(L.trigrams(texts[x])[0], minlength=L.BUCKETS) for x in sorted(texts)]) + 0.5
    share = counts / counts.sum(axis=1, keepdims=True)
    yes, no = (code.T @ share) / code.sum(axis=0)[:, None], ((1 - code).T @ share) / (1 - code).sum(axis=0)[:, None]
    return np.log(yes / no).T


def test_weights(spark, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 3)  # tasks give up their counts often
    rng = np.random.default_rng(5)
    for n in (2, 4, 9, 70):
        words = {f"l{i:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), 5)) for _ in range(30)] for i in range(n)}
        texts = {k: [" ".join(rng.choice(v, 20)) for _ in range(6)] for k, v in words.items()}
        rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
        docs = spark.createDataFrame(rows + [(-1, None, "l000"), (-2, "x", None)], "doc_id long, text string, lang string").repartition(5)
        model = L.fit(docs)
        assert model.languages == sorted(texts) and len({tuple(c) for c in model.code}) == n
        assert np.allclose(model.weights, plain_weights(texts, model.code), atol=1e-5)
        fresh = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate(sorted(words))]
        asked = spark.createDataFrame(fresh, "doc_id long, text string, lang string")
        found = {r["doc_id"]: r["lang_pred"] for r in L.language_id(asked, model).collect()}
        assert sum(found[i] == k for i, _, k in fresh) >= 0.95 * n


def test_dirty_column(spark):
    """2,000 languages of a document each: what the driver holds is 65,536 buckets by the code's bits."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("texto "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    model = L.fit(docs)
    assert model.weights.shape == (L.BUCKETS, 110) and len(model.languages) == 2000
    found = L.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred = lang").count() > 1900
