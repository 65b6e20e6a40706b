"""Sections read the products once, by shuffle, without an order or counts that nothing uses; amounts are summed exactly."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricegrain import registry
from pricegrain.plans import explorer
from pricegrain.sources.adapter import store


@pytest.mark.parametrize(("name", "times"), [("seccoes", 1), ("pesquisa_explorador", 2)])
def test_products_are_read_once(spark, sf_dir, name, times):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [p_partkey") == times and plan.count("SortMergeJoin [sku_id") == times
    assert "Expand" not in plan and plan.count("rangepartitioning") <= 1  # that of the sections themselves


def test_unordered_products(spark, sf_dir):
    """The same products, whether ordered or not, and whether lines met them first or not."""
    s = store(spark, sf_dir)
    rows = lambda frame: sorted(map(repr, frame.collect()))
    found = rows(explorer.products(s, most=None, ordered=False))
    assert found == rows(explorer.products(s, most=None)) == rows(explorer.products(s, most=10**6)) and found


def test_decimals_are_exact(spark):
    amount = F.when(F.col("id") == 0, F.lit("10000000000000.00")).otherwise(F.lit("0.01")).cast("decimal(20,2)")
    listed = spark.range(0, 100_001, 1, 1).select(F.lit("Talho").alias("categoria"), amount.alias("total_gasto"))
    assert [tuple(r) for r in explorer.by_section(listed).collect()] == [("Talho", 100_001, 10000000001000.0)]
