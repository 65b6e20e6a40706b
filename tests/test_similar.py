"""Similar names against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricegrain.functions.text import similarity
from pricegrain.operators.similar import similar_names


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 0.95])
def test_all_pairs(spark, least):
    rng = random.Random(7)
    words = ["arroz", "leite", "sal", *(f"w{i}" for i in range(12))]
    weights = [20, 10, 10, *[1] * 12]
    names = [(rng.choice(["kg", "L", None]), " ".join(rng.choices(words, weights, k=rng.randint(0, 5)))) for _ in range(260)] + [("kg", "Árroz, sal"), ("kg", "de"), ("kg", "")]
    left, right = spark.createDataFrame(names[:150], "grupo string, nome string"), spark.createDataFrame(names[110:], "grupo string, nome string")
    want = left.distinct().alias("a").crossJoin(right.distinct().alias("b")).filter("a.grupo = b.grupo").select("a.grupo", F.col("a.nome").alias("x"), F.col("b.nome").alias("y"), similarity(F.col("a.nome"), F.col("b.nome")).alias("s")).filter(F.col("s") >= least)
    found = similar_names(left, right, least).collect()
    assert len(found) > 40 and sorted(map(tuple, found)) == sorted(map(tuple, want.collect()))
    both = left.distinct()
    own = both.alias("a").crossJoin(both.alias("b")).filter("a.grupo = b.grupo and a.nome < b.nome").select("a.grupo", F.col("a.nome").alias("x"), F.col("b.nome").alias("y"), similarity(F.col("a.nome"), F.col("b.nome")).alias("s")).filter(F.col("s") >= least)
    assert sorted(map(tuple, similar_names(left, left, least, ordered=True).collect())) == sorted(map(tuple, own.collect()))
