"""Recall of nearest neighbours against brute force, on a table of two hundred lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pricegrain.llm.ann import nearest


def test_search_is_not_narrowed(spark):
    x = np.random.default_rng(2).normal(size=(51_200, 16))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, len(x), 256)
    score = u[asked] @ u.T
    score[np.arange(len(asked)), asked] = -9
    best = np.argsort(-score, axis=1)[:, :5]
    want = {(q, int(v)) for q, near in zip(asked, best, strict=True) for v in near}
    recall = lambda **a: len(want & {(r["query_id"], r["vec_id"]) for r in nearest(rows, F.col("vec_id") % 256 == 0, **a).collect()}) / len(want)
    narrow, usual = recall(ratio=1.16), recall()
    print("recall at 1.16 and as it is:", narrow, usual)
    assert usual > narrow
