"""One text on many rows without an id: what each row is given doesn't grow with their number."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricegrain.llm.suffix_dedup import LAST, removed_spans, suffix_dedup


def test_repeated_rows(spark):
    rng = random.Random(8)
    text, other = ("".join(rng.choices("abcdefghij ", k=2000)) for _ in range(2))
    sizes = set()
    for n in (30, 400):
        rows = [(None, text)] * n + [(5, text), (6, other), (7, other[:99]), (None, other[500:700])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffix_dedup(docs).collect()]
        assert sorted(map(str, found)) == sorted(map(str, [(None, 2000, 2000, 1)] * n + [(5, 2000, 0, 0), (6, 2000, 0, 0), (7, 99, 0, 0), (None, 200, 200, 1)]))
        keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("tag"), "text")
        sizes.add(removed_spans(keyed).groupBy("ord", "tag").agg(F.size(F.collect_set(F.struct("start", "stop"))).alias("n")).agg(F.max("n")).first()[0])
    assert max(sizes) < 2000


def test_toxicity_sample_bounds_rows(spark):
    from pricegrain.llm.toxicity import sample

    docs = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = sample(docs, labels, "toxic", 101, F.lit(True)).collect()
    assert len(rows) == 101 == len({r["doc_id"] for r in rows})  # labels without a document take no place
    assert len(sample(docs, labels, "toxic", 20, F.lit(True)).collect()) == 20
