"""Components, and names that are decided by component: the same as one after another, and as in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import resolve
from pricegrain.operators.components import components

LINK = "no string, candidato string, nome string, score double, igual boolean"
PRODUCT = "no string, candidato long, nome string, score double, igual boolean"


def least(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(400)]
    pairs = [(a, b) for a, b in pairs if a != b]
    rows = spark.createDataFrame([*pairs, *pairs[:50], (7, 7), (None, 3)], "a long, b long")
    assert {r["no"]: r["grupo"] for r in components(rows).collect()} == least(pairs)
    assert components(rows.limit(0)).isEmpty()


def in_order(nodes, of_products, between, yes):
    """Names one after another, in plain Python."""
    made, verdict = set(), lambda a, b: (a.lower(), b.lower()) in yes
    for no, name in sorted(nodes):
        old = [(-s, c, n) for k, c, n, s, e in of_products if k == no]
        new = [(-s, c, n) for k, c, n, s, e in between if k == no and c in made]
        if any(e or s >= resolve.SURE for k, _, _, s, e in of_products if k == no) or any(e or s >= resolve.SURE for k, c, _, s, e in between if k == no and c in made):
            continue
        best, other = min(old, default=None), min(new, default=None)
        if other and (best is None or other[0] < best[0]):
            best = other
        if best and -best[0] >= resolve.POSSIBLE and verdict(name, best[2]):
            continue
        made.add(no)
    return made


@pytest.mark.parametrize("most", [0, 12, 100_000])
def test_names_in_order(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "TASK_LINKS", most)
    rng = random.Random(8)
    nodes = [(f"t{k:03}", f"Nome {k}") for k in range(60)]
    name = dict(nodes)
    between = {(f"t{b:03}", f"t{a:03}"): rng.choice([(0.6, False), (0.7, False), (0.7, False), (0.84, False), (0.9, False), (0.0, True)]) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(45))}
    between = [(b, a, name[a], s, e) for (b, a), (s, e) in between.items()]
    of_products = [(f"t{k:03}", k % 4, f"P{k % 4}", rng.choice([0.62, 0.7, 0.8, 0.95]), False) for k in rng.sample(range(60), 25)]
    yes = {(name[r[0]].lower(), r[2].lower()) for r in between + of_products if rng.random() < 0.5}
    verdicts = spark.createDataFrame([(a, b, True) for a, b in yes], "ja string, jb string, sim boolean")
    found = resolve.new_names(spark.createDataFrame(nodes, "no string, nome string"), spark.createDataFrame(of_products, PRODUCT), spark.createDataFrame(between, LINK), verdicts)
    found = [r["no"] for r in found.collect()]
    assert len(found) == len(set(found)) and set(found) == in_order(nodes, of_products, between, yes)


def test_chain(spark):
    """500 names, each sure to be the one before: every other one is new, and no round is taken for each."""
    nodes = spark.range(500).select(F.format_string("t%03d", "id").alias("no"), F.format_string("Nome %d", "id").alias("nome"))
    chain = spark.range(1, 500).select(F.format_string("t%03d", "id").alias("no"), F.format_string("t%03d", F.col("id") - 1).alias("candidato"), F.lit("x").alias("nome"), F.lit(0.9).alias("score"), F.lit(False).alias("igual"))
    none = spark.createDataFrame([], PRODUCT)
    jobs = lambda: int(spark.sparkContext.parallelize([0], 1).map(lambda x: x).count() and spark.sparkContext._jsc.sc().dagScheduler().nextJobId())
    before = jobs()
    found = resolve.new_names(nodes, none, chain, spark.createDataFrame([], "ja string, jb string, sim boolean"))
    assert sorted(r["no"] for r in found.collect()) == [f"t{k:03}" for k in range(0, 500, 2)]
    assert jobs() - before < 300
