"""The explorer: months, products, and one product's prices, stores, statistics and verdict."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import aisle, contains_pattern, fold, fold_text, section
from ..operators.star import day, fact_items, in_month, in_period
from ..sources.tables import Store


def explored() -> Column:
    """Lines that the explorer shows: products of receipts in order, with a price per unit; clearance included."""
    return (F.col("is_non_product") == F.lit(False)) & (F.col("needs_review") == F.lit(False)) & F.col("preco_por_base").isNotNull()


def explored_lines(store: Store) -> DataFrame:
    return fact_items(store).filter(explored() & F.col("nome_canonico").isNotNull())


def months(store: Store) -> DataFrame:
    """Months with the number of their receipts in order, the earliest first; a receipt counts whatever its lines are."""
    receipts = store.fatura.filter((F.col("needs_review") == F.lit(False)) & F.col("data_compra").isNotNull())
    return receipts.groupBy(F.date_format("data_compra", "yyyy-MM").alias("mes")).agg(F.count(F.lit(1)).alias("n")).orderBy("mes")


def products(store: Store, q: str | None = None, mes: str | None = None, most: int | None = 300, ordered: bool = True) -> DataFrame:
    """Products by how often they were bought, the last bought first on a tie; of a search text or a month if given. most: None for all.

    ultimo_preco is what was paid last, of two lines of one time the one of the later id. ordered: False where only sums over
    the products are wanted; what such a sum doesn't read isn't computed either.
    """
    receipts = store.fatura.filter(F.col("needs_review") == F.lit(False))
    if mes and re.fullmatch(r"\d{4}-\d{2}", mes):
        receipts = receipts.filter(in_month(mes))
    chosen = store.sku_normalizado
    if q and q.strip():
        pattern = contains_pattern(q[:80])
        chosen = chosen.filter(fold(F.col("nome_canonico")).like(pattern) | F.coalesce(fold(F.col("nome_simplificado")).like(pattern), F.lit(False)))
    lines = store.item.filter((F.col("is_non_product") == F.lit(False)) & F.col("preco_por_base").isNotNull() & F.col("sku_id").isNotNull())
    if most is not None or chosen is not store.sku_normalizado:
        lines = lines.join(chosen.select(F.col("id").alias("sku_id")), "sku_id", "left_semi")
    lines = lines.join(receipts.select(F.col("id").alias("fatura_id"), "loja_id", "data_compra"), "fatura_id")
    grouped = lines.groupBy("sku_id").agg(
        F.countDistinct("fatura_id").alias("n_compras"),
        F.countDistinct("loja_id").alias("n_lojas"),
        F.round(F.min("preco_por_base"), 4).alias("preco_min"),
        F.round(F.max("preco_por_base"), 4).alias("preco_max"),
        F.max_by("preco_liquido", F.struct("data_compra", "id")).alias("ultimo_preco"),
        F.round(F.sum("preco_liquido"), 2).alias("total_gasto"),
        F.max("data_compra").alias("ultima"),
    )
    order = F.desc("n_compras"), F.desc("ultima"), "sku_id"
    named = chosen.select(F.col("id").alias("sku_id"), "nome_canonico", "nome_simplificado", "categoria", "unidade_base")
    # The first of an order are held in one task; all of them need none. All meet by shuffle: files of products are small for
    # what the driver would hold to broadcast them.
    top = named.hint("merge").join(grouped, "sku_id") if most is None else named.join(grouped.orderBy(*order).limit(most), "sku_id")
    return (top.orderBy(*order) if ordered else top).withColumn("ultima", day("ultima"))


def search(listed: DataFrame, q: str) -> DataFrame:
    """Of products(), those whose names hold the text as it is, without wildcards."""
    word = F.lit(fold_text(q))
    return listed.filter(fold(F.col("nome_canonico")).contains(word) | F.coalesce(fold(F.col("nome_simplificado")).contains(word), F.lit(False)))


def product_lines_of(store: Store, sku_id: int) -> DataFrame:
    return explored_lines(store).filter(F.col("sku_id") == sku_id)


def product_history(store: Store, sku_id: int) -> DataFrame:
    rows = product_lines_of(store, sku_id).orderBy("data_compra", "item_id")
    return rows.select(day().alias("data"), F.col("cadeia").alias("loja"), F.col("is_clearance").alias("promo"), F.col("preco_liquido").alias("pago"), F.col("preco_por_base").alias("unitario"), F.col("desconto_direto").alias("desconto"), normal_price().alias("normal"))


def normal_price() -> Column:
    """The unit price without the line's discount."""
    paid, off = F.col("preco_liquido").cast("double"), F.col("desconto_direto").cast("double")
    return F.when((off > 0.005) & (paid > 0), F.col("preco_por_base") * (paid + off) / paid).otherwise(F.col("preco_por_base"))


def product_stores(store: Store, sku_id: int) -> DataFrame:
    grouped = product_lines_of(store, sku_id).groupBy(F.col("cadeia").alias("loja"))
    means = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("preco_liquido").cast("double")), 2).alias("media_paga"), F.round(F.avg("preco_por_base"), 4).alias("media_unit"))
    return means.orderBy("media_paga", "loja")


def product_statistics(store: Store, metric: str = "unitario", sku_id: int | None = None) -> DataFrame:
    """One row per product, or that of one product: extremes, trend, savings and verdict of the metric (unitario or pago).

    Trend is from the first to the last line in per cent, savings what the store with the lowest mean payment would have
    saved on all lines.
    """
    value = F.col("preco_por_base" if metric == "unitario" else "preco_liquido").cast("double")
    paid = F.col("preco_liquido").cast("double")
    lines = explored_lines(store) if sku_id is None else product_lines_of(store, sku_id)
    lines = lines.select("sku_id", "cadeia", value.alias("v"), paid.alias("pago"), F.col("desconto_direto").cast("double").alias("desconto"), F.struct("data_compra", "item_id").alias("quando"))
    stores = lines.groupBy("sku_id", "cadeia").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("media"), F.avg("pago").alias("media_paga"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("sv"), F.sum("pago").alias("sp"), F.sum("desconto").alias("sd"), F.min_by("v", "quando").alias("fv"), F.min("quando").alias("fq"), F.max_by("v", "quando").alias("lv"), F.max("quando").alias("lq"))
    all_ = stores.groupBy("sku_id").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("minimo"),
        F.max("hi").alias("maximo"),
        F.min_by("fv", "fq").alias("primeiro"),
        F.max_by("lv", "lq").alias("ultimo"),
        (F.sum("sv") / F.sum("n")).alias("media"),
        F.sum("sp").alias("total"),
        F.sum("sd").alias("poupanca"),
        F.min_by("cadeia", F.struct("media", "cadeia")).alias("mais_barata"),
        F.min("media_paga").alias("menor_media"),
    )
    trend = F.when(F.col("primeiro") > 0, (F.col("ultimo") - F.col("primeiro")) / F.col("primeiro") * 100).otherwise(0.0)
    out = all_.withColumn("tendencia", trend).withColumn("pouparia", F.col("total") - F.col("menor_media") * F.col("n")).drop("menor_media")
    verdict = F.when(F.col("n") < 2, "NOVO").when(F.col("tendencia") >= 0, "A SUBIR").otherwise("A DESCER")
    return out.withColumn("veredicto", verdict).withColumn("mostra_poupanca", (F.col("veredicto") == "A SUBIR") & (F.col("pouparia") > 0.5))


def by_section(listed: DataFrame, folds: bool = True) -> DataFrame:
    """Products by shop section, in the order of the aisles. Amounts that are decimals are summed as such."""
    grouped = listed.groupBy(section(F.col("categoria"), folds).alias("seccao")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_gasto"), 2).cast("double").alias("total"))
    return grouped.orderBy(aisle(F.col("seccao")), "seccao")


def same_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines of equal name and price of a receipt as one, with the sum of their quantities (`qtd`, 1 where it is missing), in the order of the first."""
    quantity = F.coalesce("qtd", F.lit(1)) if "qtd" in lines.columns else F.lit(1)
    grouped = lines.groupBy(key, "produto", "preco").agg(F.sum(quantity).alias("qtd"), F.min("pos").alias("pos"))
    return grouped.orderBy(key, "pos")


def first_and_rest(rows: DataFrame, key: str, order: Column | str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """The first n rows of each key, which are shown, and the rest, which is folded away."""
    ranked = rows.withColumn("lugar", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter(F.col("lugar") <= n).drop("lugar"), ranked.filter(F.col("lugar") > n).drop("lugar")


def cart_total(products_chosen: DataFrame) -> DataFrame:
    """What a shopping list costs; prices that are missing count as 0."""
    return products_chosen.agg(F.round(F.coalesce(F.sum(F.col("preco").cast("double")), F.lit(0.0)), 2).alias("total"))


def euros(x: Column) -> Column:
    """An amount as it is shown: two digits behind a comma."""
    return F.replace(F.format_string("%.2f", x.cast("double")), F.lit("."), F.lit(","))


def short_day(x: Column, year: bool = False) -> Column:
    return F.date_format(x, "dd/MM/yy" if year else "dd/MM")


def cart(products_chosen: DataFrame, categories: DataFrame) -> DataFrame:
    """A shopping list (produto, preco) by section and name, with the categories of (produto, categoria)."""
    joined = products_chosen.join(categories.groupBy("produto").agg(F.min("categoria").alias("categoria")), "produto", "left")
    kind = section(F.coalesce("categoria", F.lit("")), folds=False)
    return joined.withColumn("seccao", kind).orderBy(aisle(kind), "seccao", "produto")


def spend_between(store: Store, start: str, end: str) -> DataFrame:
    return fact_items(store).filter(explored() & in_period(start, end)).agg(F.coalesce(F.sum("preco_liquido"), F.lit(0)).alias("total"))
