"""What is read again is kept first, so that joins before it run once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain import registry
from pricegrain.operators.median import medians
from pricegrain.plans import admin
from pricegrain.sources.adapter import store
from pricegrain.streaming import recurrence


def test_median_keeps_its_values(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 3000).cast("double").alias("v"))
    found = medians(rows, "g", "v", most=50)
    assert "Range" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.groupBy("g").agg(F.median("v"), F.count("v")).collect()))


def test_all_products_are_in_no_single_task(spark, sf_dir):
    for name in ("seccoes", "pesquisa_explorador"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "limit=1073741824" not in plan and "Expand" not in plan and "GlobalLimit" not in plan


def test_outliers_read_lines_once(spark, sf_dir):
    plan = admin.price_outliers(store(spark, sf_dir), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1  # the medians are those of kept values


def test_trips_are_counted_by_receipt(spark, sf_dir):
    plan = recurrence.bought(store(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") > plan.index("Join Inner")  # the products' join lies below the receipts'


def test_merge_pairs_are_bounded(spark):
    """Of 3,000 products of one name the first 100 that stay meet the others, not all each other."""
    from dataclasses import replace

    s = store(spark, "/root/testdata/sf0.001")
    n, unit = 3000, F.lit("kg").alias("unidade_base")
    products = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "maca vermelha").otherwise("maca vermelha grande").alias("nome_canonico"), unit)
    lines = spark.range(n * 3).select((F.col("id") % 7 * 400).alias("sku_id"))
    found = admin.merge_suggestions(replace(s, sku_normalizado=products, item=lines), 0.6, 50)
    used = {i: n * 3 // 7 + (r < n * 3 % 7) for r, i in ((r, r * 400) for r in range(7))}
    rank = lambda i: (used.get(i, 0), -i)
    same = sorted((a, b) for a in [*range(0, 100), *used] for b in range(n) if a % 2 == b % 2 and rank(a) > rank(b))
    assert [(r.manter, r.fundir) for r in found.collect()] == list(dict.fromkeys(same))[:50]
