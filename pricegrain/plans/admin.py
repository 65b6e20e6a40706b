"""What keeps the history in order: products, descriptions, receipts, quality, outliers, merge suggestions, costs, chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_pattern, fold, tokens
from ..functions.units import half_up
from ..operators.median import medians
from ..operators.similar import similar_names
from ..operators.star import day, fact_items
from ..sources.tables import Store, settled


def latest_verdicts(store: Store) -> DataFrame:
    """fatura_id, veredicto of each receipt's newest review."""
    return store.revisao.groupBy("fatura_id").agg(F.max_by("veredicto", "id").alias("veredicto"))


def product_list(store: Store, q: str | None = None, most: int = 200) -> DataFrame:
    """Products with the number of their lines and descriptions, most used first."""
    products = store.sku_normalizado
    if q and q.strip():
        products = products.filter(fold(F.col("nome_canonico")).like(contains_pattern(q)) | F.coalesce(fold(F.col("marca")).like(contains_pattern(q)), F.lit(False)))
    used = store.item.filter("sku_id is not null").groupBy(F.col("sku_id").alias("id")).agg(F.count(F.lit(1)).alias("n_itens"), F.countDistinct(fold(F.col("descricao_original"))).alias("n_descricoes"))
    none = F.lit(0).cast("long")
    listed = products.join(used, "id", "left").select("id", "nome_canonico", "nome_simplificado", "marca", "categoria", "unidade_base", "formato_valor", F.coalesce("n_itens", none).alias("n_itens"), F.coalesce("n_descricoes", none).alias("n_descricoes"))
    return listed.orderBy(F.desc("n_itens"), "nome_canonico", "id").limit(min(max(most, 1), 500))


def product_descriptions(store: Store, sku_id: int) -> DataFrame:
    """The receipts' texts of a product, the most frequent first."""
    found = store.item.filter(F.col("sku_id") == sku_id).groupBy(fold(F.col("descricao_original")).alias("chave"))
    return found.agg(F.min("descricao_original").alias("descricao_original"), F.count(F.lit(1)).alias("n"), F.max("fatura_id").alias("fatura_id")).orderBy(F.desc("n"), "descricao_original").drop("chave")


def free_descriptions(store: Store, q: str | None = None, most: int = 50) -> DataFrame:
    """Texts of product lines with how often they occur and a product that they belong to, if any."""
    rows = store.item.filter(F.col("is_non_product") == F.lit(False))
    if q and q.strip():
        rows = rows.filter(fold(F.col("descricao_original")).like(contains_pattern(q)))
    rows = rows.join(store.sku_normalizado.select(F.col("id").alias("sku_id"), "nome_canonico"), "sku_id", "left")
    grouped = rows.groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min("descricao_original").alias("descricao_original"), F.count(F.lit(1)).alias("n"), F.min("nome_canonico").alias("sku_atual"))
    return grouped.orderBy(F.desc("n"), "descricao_original").limit(most).drop("chave")


def receipt_list(store: Store, estado: str | None = None, most: int = 100) -> DataFrame:
    """Receipts with their store, number of lines and newest verdict; estado: pendente, erro or ok. Newest first."""
    shop = store.loja.select(F.col("id").alias("loja_id"), "cadeia", F.col("nome").alias("loja"))
    verdict = latest_verdicts(store).withColumnRenamed("fatura_id", "id")
    counted = store.item.groupBy(F.col("fatura_id").alias("id")).agg(F.count(F.lit(1)).alias("n_itens"))
    rows = store.fatura.join(shop, "loja_id").join(verdict, "id", "left")
    if estado == "pendente":
        rows = rows.filter("veredicto is null")
    elif estado in ("erro", "ok"):
        rows = rows.filter(F.col("veredicto") == estado)
    top = rows.orderBy(F.desc("id")).limit(min(max(most, 1), 500))
    kept = top.select("id", "data_compra", "cadeia", "loja", "total_impresso", "needs_review", "metodo_extracao", "veredicto")
    return kept.join(counted, "id", "left").withColumn("n_itens", F.coalesce("n_itens", F.lit(0).cast("long"))).orderBy(F.desc("id"))


def receipt_lines(store: Store, fatura_id: int) -> DataFrame:
    product = store.sku_normalizado.select(F.col("id").alias("sku_id"), "nome_canonico", "unidade_base")
    return store.item.filter(F.col("fatura_id") == fatura_id).join(product, "sku_id", "left").orderBy("id")


def quality(store: Store, by: Column | str) -> DataFrame:
    """Receipts by a dimension (cadeia, origem_captura, metodo_extracao): reconciled, mean discrepancy, reviewed, ok, wrong."""
    shop = store.loja.select(F.col("id").alias("loja_id"), "cadeia")
    rows = store.fatura.join(shop, "loja_id").join(latest_verdicts(store).withColumnRenamed("fatura_id", "id"), "id", "left")
    grouped = rows.groupBy(F.coalesce(by if isinstance(by, Column) else F.col(by), F.lit("—")).alias("grupo"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("needs_review") == F.lit(False)).alias("reconciliadas"),
        F.round(F.avg(F.abs(F.col("discrepancia").cast("double"))), 3).alias("disc_media"),
        F.count("veredicto").alias("revistas"),
        F.count_if(F.col("veredicto") == "ok").alias("ok"),
        F.count_if(F.col("veredicto") == "erro").alias("erro"),
    ).orderBy(F.desc("n"), "grupo")


def quality_by_model(store: Store) -> DataFrame:
    ok = F.count_if(F.col("needs_review") == F.lit(False))
    grouped = store.fatura.groupBy(F.coalesce("modelo", F.lit("—")).alias("modelo_usado"), "metodo_extracao")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), ok.alias("ok"), F.round(100.0 * ok / F.count(F.lit(1)), 1).alias("pct_ok"), F.round(F.avg(F.abs(F.col("discrepancia").cast("double"))), 3).alias("disc_media"))
    return out.withColumnRenamed("modelo_usado", "modelo").orderBy(F.desc("n"), "modelo", "metodo_extracao")


def price_outliers(store: Store, factor: float = 3.0) -> DataFrame:
    """Lines whose price per unit is over `factor` times the product's median or under that part of it; receipts under review count too.

    Prices of 0 or less neither move a median nor are outliers. desvio is the price divided by the median, so below 1 for low prices.
    """
    factor = min(max(float(factor or 3.0), 1.5), 20.0)
    rows = fact_items(store).filter((F.col("is_non_product") == F.lit(False)) & (F.col("is_clearance") == F.lit(False)) & (F.col("preco_por_base") > 0) & F.col("nome_canonico").isNotNull())
    rows = rows.select("item_id", "fatura_id", "sku_id", "nome_canonico", "unidade_base", "descricao_original", "quantidade", "preco_liquido", "cadeia", "data_compra", F.col("preco_por_base").cast("double").alias("preco_por_base"))
    usual = medians(rows, "sku_id", "preco_por_base").filter((F.col("n") >= 2) & (F.col("mediana") > 0))
    joined = rows.join(usual, "sku_id")
    odd = (F.col("preco_por_base") > F.col("mediana") * factor) | (F.col("preco_por_base") < F.col("mediana") / factor)
    return joined.filter(odd).withColumn("desvio", F.floor(F.col("preco_por_base") / F.col("mediana") * 10 + 0.5) / 10)


def outliers_by_product(outliers: DataFrame) -> DataFrame:
    """price_outliers() with an array of lines per product, the largest deviation first."""
    line = F.struct((-F.col("desvio")).alias("ordem"), "item_id", "fatura_id", "descricao_original", "quantidade", "preco_liquido", "preco_por_base", "cadeia", day().alias("data"), "desvio")
    grouped = outliers.groupBy("sku_id", "nome_canonico", "unidade_base", "mediana", "n").agg(F.array_sort(F.collect_list(line)).alias("itens"), F.max("desvio").alias("maior_desvio"))
    return grouped.withColumn("mediana", F.round("mediana", 4)).orderBy(F.desc("maior_desvio"), "sku_id")


def used_products(store: Store) -> DataFrame:
    """Products with the number of their lines."""
    used = store.item.filter("sku_id is not null").groupBy(F.col("sku_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return store.sku_normalizado.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def merge_suggestions(store: Store, threshold: float = 0.6, most: int = 100) -> DataFrame:
    """Pairs of products of one unit with similar names; the one used more stays.

    Names, each distinct one once, meet by their rare words (similar.py). Scores have two
    digits, by which they are ordered. Products of equal names are pairs too. Of equal scores those of the smallest ids
    come first.
    """
    threshold = min(max(float(threshold or 0.6), 0.3), 0.95)
    products = settled(used_products(store).select("id", "nome_canonico", "unidade_base", "n"))
    names = products.select(F.col("unidade_base").alias("grupo"), F.col("nome_canonico").alias("nome"))
    alike = similar_names(names, names, threshold, ordered=True).withColumnRenamed("grupo", "unidade_base").withColumn("score", half_up(F.col("score"), 2))
    left = products.select(F.col("id").alias("id_a"), F.col("nome_canonico").alias("nome_a"), "unidade_base", F.col("n").alias("n_a"))
    right = products.select(F.col("id").alias("id_b"), F.col("nome_canonico").alias("nome_b"), "unidade_base", F.col("n").alias("n_b"))
    # Every pair of names is a pair of products at least, so pairs below the score of the last of `most` can't come out.
    last = alike.orderBy(F.desc("score")).limit(most).agg(F.min("score").alias("last"))
    top_names = alike.join(F.broadcast(last), F.col("score") >= F.col("last")).drop("last")
    same = products.filter(F.size(tokens(F.col("nome_canonico"))) > 0).select("unidade_base", "nome_canonico").distinct().select("unidade_base", F.col("nome_canonico").alias("nome_a"), F.col("nome_canonico").alias("nome_b"), F.lit(1.0).alias("score"))
    other = top_names.select("unidade_base", F.col("nome_b").alias("nome_a"), F.col("nome_a").alias("nome_b"), "score")
    names = settled(top_names.unionByName(other).unionByName(same))
    # Of a pair the one used more stays, of equals the smaller id. A product that stays is in a pair with the other name's least one, so
    # no pairs are needed to find the first `most` products that stay; only these meet all that are less.
    use = lambda n, i: F.struct(F.col(n).alias("n"), (-F.col(i)).alias("i"))
    least = products.groupBy("unidade_base", F.col("nome_canonico").alias("nome_b")).agg(F.min(use("n", "id")).alias("menor"))
    stays = left.join(names.join(least, ["unidade_base", "nome_b"]), ["unidade_base", "nome_a"]).withColumn("uso", use("n_a", "id_a")).filter(F.col("uso") > F.col("menor"))
    stays = stays.select("id_a", "nome_a", "uso", "nome_b", "unidade_base", "score")
    place = F.struct((-F.col("score")).alias("s"), F.col("id_a").alias("i"))
    end = stays.orderBy(F.desc("score"), "id_a").limit(most).agg(F.max(place).alias("fim"))
    first = settled(stays.join(F.broadcast(end), place <= F.col("fim")).drop("fim"))  # whoever is equal to the last, too
    pairs = right.join(F.broadcast(first), ["unidade_base", "nome_b"]).filter(use("n_b", "id_b") < F.col("uso"))
    out = pairs.select(F.col("id_a").alias("manter"), F.col("nome_a").alias("manter_nome"), F.col("id_b").alias("fundir"), F.col("nome_b").alias("fundir_nome"), "unidade_base", "score")
    return out.orderBy(F.desc("score"), "manter", "fundir").limit(most)


def orphans(store: Store) -> DataFrame:
    """Products without a line."""
    return store.sku_normalizado.join(store.item.select(F.col("sku_id").alias("id")), "id", "left_anti")


def unresolved(store: Store) -> DataFrame:
    """Distinct texts of product lines without a product."""
    rows = store.item.filter(F.col("sku_id").isNull() & (F.col("is_non_product") == F.lit(False)))
    return rows.groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min("descricao_original").alias("descricao_original")).select("descricao_original")


def costs(store: Store, by: str | None = None) -> DataFrame:
    """Calls and what they cost, in all or by contexto or modelo."""
    total = (F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("custo"), F.lit(0)), 6).alias("custo"))
    if by is None:
        return store.custo_chamada.agg(*total)
    return store.custo_chamada.groupBy(by).agg(*total).orderBy(F.desc("custo"), by)


def last_messages(store: Store, n: int = 20, utilizador: str | None = None, most: int = 100) -> DataFrame:
    """Each user's (or one user's) last n messages, oldest first."""
    n = min(max(int(n or 20), 1), most)
    rows = store.mensagem if utilizador is None else store.mensagem.filter(F.col("utilizador") == utilizador)
    rank = F.row_number().over(Window.partitionBy("utilizador").orderBy(F.desc("id")))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn").orderBy("utilizador", "id")


def facts_of(store: Store, utilizador: str, n: int = 50) -> DataFrame:
    return store.perfil.filter(F.col("utilizador") == utilizador).orderBy("id").limit(min(max(int(n or 50), 1), 200)).select("id", "fato")


def score_board(results: DataFrame, by: str) -> DataFrame:
    """Runs of an extraction comparison (by, total, lido, erro) by method or model: n, exact, summed difference, failures."""
    gap = F.abs(F.col("lido") - F.col("total"))
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 0.015).alias("ok"), F.round(F.sum(gap), 2).alias("desvio"), F.count("erro").alias("erros")).orderBy(F.desc("ok"), by)


def traffic_light(part: Column, whole: Column) -> Column:
    """good from 80 per cent, medium from 50, else bad."""
    percent = F.floor(part / F.nullif(whole, F.lit(0)) * 100 + 0.5)
    return F.when(percent >= 80, "good").when(percent >= 50, "medium").otherwise("bad")
