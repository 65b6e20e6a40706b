"""The star that most queries read, and the filters that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_pattern, expand_target, fold, fold_text, normal_name, term_similarity
from ..sources.tables import Store
from .search import names_like, texts_with

#: Folded letters from which a term is also looked for by its spelling, and how alike a name must then be.
FUZZY_LETTERS, FUZZY = 4, 0.7


def named_products(store: Store) -> DataFrame:
    """Products as the lines read them, with the folded names by which lines are grouped: folded once for each product."""
    folded = fold(F.col("nome_canonico")).alias("chave_longa"), fold(F.coalesce("nome_simplificado", "nome_canonico")).alias("chave_curta")
    return store.sku_normalizado.select(F.col("id").alias("sku_id"), "nome_canonico", "nome_simplificado", "marca", "categoria", "unidade_base", *folded)


def with_receipts(items: DataFrame, store: Store) -> DataFrame:
    """Lines with their receipt and store. Receipts meet their stores first, so that lines, which are many more, are shuffled once. Join sides are left to Catalyst and its sizes."""
    receipt = store.fatura.select(F.col("id").alias("fatura_id"), "loja_id", "data_compra", "needs_review", "criado_em")
    shop = store.loja.select(F.col("id").alias("loja_id"), "cadeia", F.col("nome").alias("loja"))
    return items.withColumnRenamed("id", "item_id").join(receipt.join(shop, "loja_id"), "fatura_id")


def fact_items(store: Store) -> DataFrame:
    """Every line with its receipt and store, and its product if it has one."""
    return with_receipts(store.item, store).join(named_products(store), "sku_id", "left")


def display_name() -> Column:
    return F.coalesce("nome_canonico", "descricao_original")


def day(column: str = "data_compra") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def product_lines(clearance: bool = True) -> Column:
    """Lines that are products of receipts in order; a null flag doesn't count as false."""
    keep = (F.col("is_non_product") == F.lit(False)) & (F.col("needs_review") == F.lit(False))
    return keep if clearance else keep & (F.col("is_clearance") == F.lit(False))


def in_period(start: str | None = None, end: str | None = None, column: str = "data_compra") -> Column:
    """Days from start to end, both included; open where a bound is missing, but for a day after today."""
    when = F.to_date(column)
    return when.between(F.lit(start or "1900-01-01").cast("date"), F.lit(end).cast("date") if end else F.current_date())


def in_month(month: str, column: str = "data_compra") -> Column:
    """A half-open range, so that it reaches the scan."""
    start = F.lit(f"{month}-01").cast("date")
    return (F.col(column) >= start.cast("timestamp_ntz")) & (F.col(column) < F.add_months(start, 1).cast("timestamp_ntz"))


def in_store(name: str | None) -> Column:
    """Chain or store name contains `name`; all stores without one."""
    if not (name and str(name).strip()):
        return F.lit(True)
    return like(("cadeia", "loja"), name)


def like(columns: tuple[str, ...], term: str) -> Column:
    """Any of the columns contains the term, whatever its case and accents."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(fold(F.col(c)).like(contains_pattern(term)), F.lit(False))
    return out


def match_product(store: Store, target: str) -> DataFrame:
    """fact_items() whose product, brand, category or description contains a term of the target.

    A single term that no product contains is also looked for by its spelling: products whose name or one of its words is
    alike to FUZZY count. Products are judged once each, lines by their description only, and just the lines that are left
    meet receipts and stores. All is one plan; nothing is fetched to decide. With an index of the store, descriptions are
    found in its lists and lines meet the texts that were found, and spelling is looked up; no line is folded.
    """
    terms = expand_target(target)
    found, written = F.lit(False), F.lit(False)
    for term in terms:
        found = found | like(("nome_canonico", "marca", "categoria"), term)
        written = written | like(("descricao_original",), term)
    products = named_products(store).withColumn("achado", found)
    if len(terms) == 1 and len(fold_text(terms[0]).replace(" ", "")) >= FUZZY_LETTERS:
        known = products.agg(F.coalesce(F.max("achado"), F.lit(False)).alias("conhecido"))  # one row
        alike = similar_products(store, terms[0]).select(F.col("id").alias("sku_id"), F.lit(True).alias("parecido"))
        products = products.join(alike, "sku_id", "left").join(F.broadcast(known))
        products = products.withColumn("achado", F.col("achado") | ~F.col("conhecido") & F.coalesce("parecido", F.lit(False))).drop("conhecido", "parecido")
    lines = store.item.join(products, "sku_id", "left")
    if store.indice is not None:
        texts = texts_with(store.indice.textos, terms).select(F.col("texto").alias("descricao_original"), F.lit(True).alias("escrito"))
        lines, written = lines.join(texts, "descricao_original", "left"), F.coalesce("escrito", F.lit(False))
    return with_receipts(lines.filter(F.coalesce("achado", F.lit(False)) | written).drop("achado", "escrito"), store)


def similar_products(store: Store, term: str, least: float = FUZZY) -> DataFrame:
    """id, nome_canonico, score of the products whose name is spelled like the term."""
    if store.indice is not None:
        return names_like(store.indice, term, least)
    names = store.sku_normalizado.select("id", "nome_canonico").filter(normal_name(F.col("nome_canonico")) != "")
    return names.withColumn("score", term_similarity(F.lit(term), F.col("nome_canonico"))).filter(F.col("score") >= least)


def target_lines(store: Store, target: str | None) -> DataFrame:
    """Lines of a target; all of them without one or for "tudo"."""
    return fact_items(store) if not target or fold_text(target) == "tudo" else match_product(store, target)
