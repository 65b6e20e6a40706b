"""Near copies of the pipeline against exact resemblance."""

from __future__ import annotations

import numpy as np

from pricegrain.llm.simhash import shingles, similar_groups


def test_similar_groups(spark):
    rng = np.random.default_rng(7)
    rows: list[tuple] = []
    for _ in range(120):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, rng.integers(5, 90))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):  # resemblances around 0.8: words at the end go or come
            cut = rng.integers(0, 2 + len(words) // 4)
            more = [f"v{x}" for x in rng.integers(0, 1 << 30, rng.integers(0, 2 + len(words) // 8))]
            rows.append((len(rows), " ".join(words[: len(words) - cut] + more)))
    line = "one line that comes again and again in this text "
    rows += [(len(rows), line * 40 + rows[0][1]), (len(rows) + 1, line + rows[0][1]), (len(rows) + 2, ""), (len(rows) + 3, None), (None, rows[0][1]), (3, rows[3][1])]
    sets = [set(shingles(t or "", 5)) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [b if x == a else x for x in part]
    want = {p: min((i for (i, _), x in zip(rows, part, strict=True) if x == p and i is not None), default=-1) for p in part}
    found = [(-1 if r[0] is None else r[0], r[1]) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted((-1 if i is None else i, want[p]) for (i, _), p in zip(rows, part, strict=True))
