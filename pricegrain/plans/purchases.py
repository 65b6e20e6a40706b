"""Questions about purchases: the last one, stores compared, history, totals, lists, the cheapest, receipts, habits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators.star import day, display_name, fact_items, in_period, in_store, match_product, product_lines, target_lines
from ..sources.tables import Store


def newest():  # noqa: ANN201
    return F.desc("data_compra"), F.desc("item_id")


def last_purchase(store: Store, produto: str) -> DataFrame:
    """The most recent line of a product, clearance included; no row without one."""
    lines = match_product(store, produto).filter(product_lines())
    top = lines.orderBy(*newest()).limit(1)
    return top.select(display_name().alias("produto"), F.col("preco_liquido").alias("preco"), "preco_por_base", "unidade_base", "loja", "cadeia", day().alias("data"), "is_clearance")


def compare_stores(store: Store, produto: str) -> DataFrame:
    """Each store's most recent price of a product per unit, cheapest first."""
    lines = match_product(store, produto).filter(product_lines(clearance=False) & F.col("preco_por_base").isNotNull())
    rank = F.row_number().over(Window.partitionBy("loja_id").orderBy(*newest()))
    return lines.withColumn("rn", rank).filter("rn = 1").orderBy("preco_por_base", "loja_id").select("cadeia", "loja", "preco_por_base", "unidade_base", day().alias("data"))


def price_history(store: Store, produto: str, desde: str | None = None) -> DataFrame:
    lines = match_product(store, produto).filter(product_lines(clearance=False))
    if desde:
        lines = lines.filter(F.to_date("data_compra") >= F.lit(desde).cast("date"))
    return lines.orderBy("data_compra", "item_id").select(day().alias("data"), "cadeia", "loja", "preco_por_base", "preco_liquido", "unidade_base")


def total_spent(store: Store, alvo: str | None = None, loja: str | None = None, periodo_inicio: str | None = None, periodo_fim: str | None = None) -> DataFrame:
    lines = target_lines(store, alvo).filter(product_lines() & in_period(periodo_inicio, periodo_fim) & in_store(loja))
    end = F.lit(periodo_fim) if periodo_fim else F.current_date().cast("string")
    return lines.agg(F.coalesce(F.sum("preco_liquido"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_itens")).select(
        F.lit(alvo or "tudo").alias("alvo"), F.lit(loja).cast("string").alias("loja"), F.lit(periodo_inicio or "1900-01-01").alias("periodo_inicio"), end.alias("periodo_fim"), "total", "n_itens"
    )


def list_purchases(store: Store, periodo_inicio: str | None = None, periodo_fim: str | None = None, alvo: str | None = None, loja: str | None = None, agrupar_por: str = "item") -> DataFrame:
    """Lines in order of date, store and line; or, by product, how often each was bought and for how much."""
    lines = target_lines(store, alvo).filter(product_lines() & in_period(periodo_inicio, periodo_fim) & in_store(loja))
    if str(agrupar_por).lower() == "produto":
        lines = lines.select(display_name().alias("nome"), F.coalesce("chave_longa", fold(F.col("descricao_original"))).alias("chave"), "preco_liquido")
        grouped = lines.groupBy("chave").agg(F.min("nome").alias("produto"), F.count(F.lit(1)).alias("vezes"), F.round(F.sum("preco_liquido"), 2).alias("total"))
        return grouped.orderBy(F.desc("total"), "produto").select("produto", "vezes", "total")
    return lines.orderBy("data_compra", "loja", "item_id").select(day().alias("data"), "cadeia", "loja", display_name().alias("produto"), "preco_liquido")


def cheapest_products(store: Store, alvo: str, loja: str | None = None, most: int = 10) -> DataFrame:
    """Each matching product's most recent price per unit, the cheapest first."""
    lines = match_product(store, alvo).filter(product_lines(clearance=False) & F.col("preco_por_base").isNotNull() & in_store(loja))
    rank = F.row_number().over(Window.partitionBy(fold(display_name())).orderBy(*newest()))
    top = lines.withColumn("produto", display_name()).withColumn("rn", rank).filter("rn = 1").orderBy("preco_por_base", "produto").limit(most)
    return top.select("cadeia", "loja", "produto", "preco_por_base", "unidade_base", day().alias("data"))


def receipt_details(store: Store, loja: str | None = None, data: str | None = None) -> DataFrame:
    """The receipt that was added last, of a store or a day if asked for, with all its lines as an array; no row if none fits."""
    shop = store.loja.select(F.col("id").alias("loja_id"), "cadeia", F.col("nome").alias("loja"))
    receipts = store.fatura.join(shop, "loja_id").filter(in_store(loja))
    if data:
        receipts = receipts.filter(F.to_date("data_compra") == F.lit(data).cast("date"))
    top = receipts.orderBy(F.desc("criado_em"), F.desc("id")).limit(1).select(F.col("id").alias("fatura_id"), "loja", "cadeia", day().alias("data"), F.col("total_impresso").alias("total"), F.col("needs_review").alias("em_revisao"), "metodo_extracao")
    product = store.sku_normalizado.select(F.col("id").alias("sku_id"), "nome_canonico")
    lines = store.item.join(F.broadcast(top.select("fatura_id")), "fatura_id", "left_semi").join(product, "sku_id", "left")
    line = F.struct("id", display_name().alias("produto"), "descricao_original", F.coalesce("preco_unitario", "preco_liquido").alias("preco"))
    listed = lines.groupBy("fatura_id").agg(F.array_sort(F.collect_list(line)).alias("itens"))  # the lines of one receipt
    shown = F.transform("itens", lambda x: F.struct(x["produto"].alias("produto"), x["descricao_original"].alias("descricao_original"), x["preco"].alias("preco")))
    return top.join(listed, "fatura_id", "left").select("loja", "cadeia", "data", "total", "em_revisao", "metodo_extracao", shown.alias("itens"))


def habitual_products(store: Store, min_idas: int | None = None, periodo_inicio: str | None = None, periodo_fim: str | None = None, loja: str | None = None, most: int = 40) -> DataFrame:
    """Products bought on several trips, the most frequent first."""
    name = F.coalesce("nome_simplificado", "nome_canonico", "descricao_original").alias("nome")
    key = F.coalesce("chave_curta", fold(F.col("descricao_original"))).alias("chave")
    lines = fact_items(store).filter(product_lines() & in_period(periodo_inicio, periodo_fim) & in_store(loja)).select(name, key, "categoria", "fatura_id", "data_compra", "item_id", "preco_liquido")
    trips = lines.groupBy("chave", "fatura_id").agg(  # a trip's day and prices first, so that only months are counted as distinct
        F.min("nome").alias("nome"),
        F.max("categoria").alias("categoria"),
        F.max("data_compra").alias("data_compra"),
        F.count(F.lit(1)).alias("n"),
        F.sum("preco_liquido").alias("pago"),
        F.max(F.struct("data_compra", "item_id", "preco_liquido")).alias("ultimo"),
    )
    grouped = trips.groupBy("chave").agg(
        F.min("nome").alias("produto"),
        F.max("categoria").alias("categoria"),
        F.count(F.lit(1)).alias("idas"),
        F.countDistinct(F.date_format("data_compra", "yyyy-MM")).alias("meses"),
        F.sum("n").alias("unidades"),
        F.round(F.sum("pago"), 2).alias("total"),
        F.max("ultimo")["preco_liquido"].alias("ultimo_preco"),
    )
    return grouped.filter(F.col("idas") >= max(2, int(min_idas or 2))).orderBy(F.desc("idas"), F.desc("meses"), F.desc("unidades"), "produto").limit(most).drop("chave")


def habitual_lately(store: Store, hoje: str | None = None, days: int = 60) -> DataFrame:
    """habitual_products() of the last days."""
    today = date.fromisoformat(hoje) if hoje else date.today()
    return habitual_products(store, 2, (today - timedelta(days=days)).isoformat(), today.isoformat())
