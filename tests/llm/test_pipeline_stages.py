"""Every stage of the pipeline against brute force, on a small table with nulls, copies, repeated rows and odd columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pricegrain.llm import toxicity
from pricegrain.llm.common import small_batches
from pricegrain.llm.registry import tokenizer
from pricegrain.llm.simhash import shingles

DDL = "doc_id long, text string, lang string, source string, n_chars long, node string, tag string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    word = lambda: f"word{rng.integers(400)}"
    passage = " ".join(f"passage{i}" for i in range(60))
    out: list[tuple] = []
    for i in range(60):
        words = [word() for _ in range(rng.integers(6, 120))]
        text = " ".join(words) + (f" {passage} " + word() if i % 5 == 0 else "")
        out.append((i, text, "en", None, len(text), None, "t"))
        if i % 3 == 0:
            out.append((200 + i, text.upper(), None, "s", None, "n", None))  # an exact copy
        if i % 4 == 0:
            near = [*words[:-1], "changed"] if i % 8 else [*words, "added"]
            out.append((100 + i, " ".join(near), "en", "s", 1, "n", "t"))
    out += [out[0], out[0], (None, out[1][1], "en", None, 5, None, None), (None, "alone without an id", None, None, 5, None, None), (None, "alone without an id", None, None, 5, None, None), (300, None, None, None, None, None, None), (301, "", "en", "s", 0, "n", "t"), (302, "scum " * 40_000, "en", "s", 200_000, "n", "t")]
    return out


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def run(spark, name, rows, sf_dir):
    small_batches(spark)
    docs = spark.createDataFrame(rows, DDL).repartition(4)
    found = stage(name)(spark, docs, sf_dir)
    assert name == "best_fit_packing" or found.columns == docs.columns
    assert stage(name)(spark, docs.limit(0), sf_dir).count() == 0
    return [tuple(r) for r in found.collect()]


def counted(rows):
    return Counter(map(tuple, rows))


def test_toxicity_stage(spark, sf_dir, rows):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = [tuple(r) for r in stage("toxicity")(spark, documents, sf_dir).collect()]
    from pyspark.sql import functions as F

    from pricegrain.llm.common import remainder

    model = toxicity.fit(documents, labels, allowed=remainder(F.col("doc_id"), 3) != 1)
    assert counted(found) == counted(tuple(r) for r in documents.collect() if model.score(r["text"] or "") < 0.7)
    assert stage("toxicity")(spark, spark.createDataFrame(rows, DDL), sf_dir).columns == DDL.replace("long", "").replace("string", "").replace(" ", "").split(",")


def test_exact_stage(spark, sf_dir, rows):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    best: dict[str, tuple] = {}
    for r in rows:
        rank = (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "")
        if lower(r[1]) not in best or rank < best[lower(r[1])][0]:
            best[lower(r[1])] = (rank, r)
    assert counted(run(spark, "exact_dedup", rows, sf_dir)) == counted(r for _, r in best.values())


def test_near_stage(spark, sf_dir, rows):
    sets = [set(shingles(r[1] or "", 5)) for r in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [part[j] if x == part[i] else x for x in part]
    found = run(spark, "simhash_near_dedup", rows, sf_dir)
    least = {p: min((r[0] for r, x in zip(rows, part, strict=True) if x == p and r[0] is not None), default=None) for p in part}
    texts = {p: {r[1] or "" for r, x in zip(rows, part, strict=True) if x == p and r[0] == least[p]} for p in part}
    assert counted(found) == counted(r for r, p in zip(rows, part, strict=True) if (r[1] or "") in texts[p])


def test_suffix_stage(spark, sf_dir, rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen: dict[bytes, tuple] = {}
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    raw = [(r[1] or "").encode() for r in rows]
    for i in order:
        for at in range(len(raw[i]) - 99):
            piece = raw[i][at : at + 100]
            seen[piece] = min(seen.get(piece, (*key(i), at)), (*key(i), at))
    want = []
    for i, r in enumerate(rows):
        gone = np.zeros(len(raw[i]), dtype=bool)
        for at in range(len(raw[i]) - 99):
            if seen[raw[i][at : at + 100]] < (*key(i), at):
                gone[at : at + 100] = True
        text = np.frombuffer(raw[i], np.uint8)[~gone].tobytes().decode()
        want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    assert counted(run(spark, "suffix_array_dedup", rows, sf_dir)) == counted(want)


def test_packing_stage(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    small_batches(spark)
    found = stage("best_fit_packing")(spark, spark.createDataFrame(rows, DDL), sf_dir).collect()
    assert sum(r["length"] for r in found) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    room = Counter()
    for r in found:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048 and len(room) == -(-sum(room.values()) // 2048)
