"""Suggestions to merge products against all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain.functions.text import similarity
from pricegrain.plans import admin
from pricegrain.sources.tables import Store, complete


def test_suggestions_of_unique_names(spark):
    names = [(i, f"Alone{i} only{i}", "un") for i in range(150)] + [(200 + i, f"Arroz{i // 2} agulha marca{i // 2} {'extra' if i % 2 else 'longo'}", "kg") for i in range(150)] + [(400 + i, f"Sal fino{i // 3}", "kg") for i in range(9)]
    products = complete(spark.createDataFrame(names, "id long, nome_canonico string, unidade_base string"), "sku_normalizado")
    lines = complete(spark.createDataFrame([(i, 1, 201 + 2 * (i % 9)) for i in range(30)], "id long, fatura_id long, sku_id long"), "item")
    shop = Store(products, products, products, lines)
    p = admin.used_products(shop).select("id", "nome_canonico", "unidade_base", "n")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.crossJoin(b).filter("a.id < b.id and a.unidade_base = b.unidade_base").select(F.struct("a.id", "a.n").alias("a"), F.struct("b.id", "b.n").alias("b"), similarity(F.col("a.nome_canonico"), F.col("b.nome_canonico")).alias("score")).filter("score >= 0.6").collect()
    want = sorted((-round(r["score"], 4), *((r["a"]["id"], r["b"]["id"]) if r["a"]["n"] >= r["b"]["n"] else (r["b"]["id"], r["a"]["id"]))) for r in pairs)[:100]
    found = [(-r["score"], r["manter"], r["fundir"]) for r in admin.merge_suggestions(shop).collect()]
    assert found == want and len({x[0] for x in want}) > 1
