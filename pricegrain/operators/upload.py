"""An upload as one dataflow: extractions become stores, receipts, lines, products and aliases, in one commit.

Extractions are read, folded, reconciled and, where they don't add up, asked for again; receipts that are there already stay
out; texts are resolved to products; prices follow the products' units; and all changed relations become one version of the
catalog, so no reader sees half an upload.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, normal_name
from ..sources.catalog import Catalog
from ..sources.extractions import readable_only
from ..sources.tables import Store, complete
from . import receipts as rc
from .dml import identical_names, merge, new_receipts, receipt_keys, reprocess, settled, stored_lines, upsert_stores, with_ids
from .resolve import given_products, resolve, resolved_texts, with_aliases

#: Columns of an upload besides its key: who sent it, how it was read, and the kept file.
ABOUT = "metodo_extracao string, modelo string, origem_captura string, ficheiro_original string, utilizador string"
#: The head of an extraction that is kept as a snapshot; the lines follow.
HEAD = ("loja", "data_compra", "desconto_global", "iva", "total_impresso")
#: The fields of a folded line that its row in the relation comes from.
LINES = ("pos", "descricao_original", "linha_peso", "desconto_direto", "quantidade", "is_clearance", "is_non_product")


def judged(extractions: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per extraction that can be read: what reconciliation and line checks say of it, and its folded lines.

    key, numero_fatura, loja and the other fields of the extraction, subtotal, convencao, total_reconciliado, discrepancia,
    bate, n_fora, linhas, precos (pos, preco_unitario, preco_liquido), pista, fora (the first line that doesn't add up), and
    the columns `keep`. Everything is computed within the extraction's row.
    """
    read = readable_only(extractions.select(key, *keep, "extracao_json").filter(F.col(key).isNotNull()))
    fields = (F.col(f"extracao.{f}").alias(f) for f in (*HEAD, "numero_fatura"))
    rows = rc.reconciled(rc.folded(read.select(key, *keep, *fields, F.col("extracao.itens").alias("itens")).withColumn("lidas", F.col("itens"))))
    rows = rc.checked(rows.withColumnRenamed("itens", "precos")).withColumn("n_fora", F.size("erradas").cast("long"))
    wrong = F.get("erradas", F.lit(0))
    fora = F.when(wrong.isNotNull(), F.struct(*(wrong[c].alias(c) for c in ("descricao_original", "quantidade", "preco_unitario", "valor", "esperado"))))
    return rows.withColumn("fora", fora).drop("erradas")


def snapshot() -> Column:
    """The extraction as it was read, as JSON."""
    return F.to_json(F.struct(*HEAD, F.col("lidas").alias("itens")))


def read_well(extractions: DataFrame, key: str, again: Callable[[DataFrame, int], DataFrame] | None = None, most: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """judged() extractions, after up to `most` corrections, with their columns `keep`.

    again: an injected step that is given the open receipts, with what is wrong with them, and the number of the try; it
    returns key, extracao_json of those that it could read again.
    """
    first = judged(extractions, key, keep)

    def better(rows: DataFrame, number: int) -> DataFrame:
        return judged(again(rows, number), key).join(rows.select(key, *keep), key).select(*rows.columns)

    return first if again is None else rc.corrected(first, better, key, most)


def stored_receipts(read: DataFrame, key: str, fatura: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New receipts with ids, without their snapshots, and key, fatura_id, duplicada of every row of read (key, loja_id, n_linhas, the fields of judged(), ABOUT).

    Receipts count as inserted in the order of their keys; a duplicate's fatura_id is that of the first it equals. New receipts
    have n_linhas and antes_n_linhas, the lines of those before.
    """
    number = F.substring(F.trim("numero_fatura"), 1, 60)
    rows = read.withColumn("numero", F.nullif(number, F.lit(""))).withColumn("quando", rc.purchase_time(F.col("data_compra")))
    about = [c.split()[0] for c in ABOUT.split(", ") if not c.startswith("utilizador")]
    rows = rows.select(
        F.col(key).alias("chave_envio"), "loja_id", F.col("quando").alias("data_compra"), F.col("numero").alias("numero_fatura"), "total_impresso", "total_reconciliado", "discrepancia",
        (~F.col("bate") | (F.col("n_fora") > 0)).alias("needs_review"), F.coalesce("desconto_global", F.lit(0.0)).alias("desconto_global"), *about, "n_linhas",
    )
    # Judged in the order of their keys; only those that stay are numbered.
    kept = new_receipts(rows.withColumn("id", F.col("chave_envio")), fatura)
    fresh = settled(with_ids(kept, fatura, ["chave_envio"], counted="n_linhas"))
    shared = ("id", "loja_id", "numero_fatura", "data_compra", "total_impresso")
    everyone = receipt_keys(fatura.select(*shared).unionByName(fresh.select(*shared)))
    gone = settled(receipt_keys(rows.join(fresh.select("chave_envio"), "chave_envio", "left_anti")).select("chave_envio", "kn", "kt"))
    by = lambda k: everyone.select("id", k).join(gone.select("chave_envio", k), k).select("chave_envio", "id")
    equal = by("kn").unionByName(by("kt")).groupBy("chave_envio").agg(F.min("id").alias("fatura_id"))
    told = fresh.select("chave_envio", F.col("id").alias("fatura_id"), F.lit(False).alias("duplicada")).unionByName(equal.withColumn("duplicada", F.lit(True)))
    return fresh, told.withColumnRenamed("chave_envio", key)


def new_texts(lines: DataFrame) -> DataFrame:
    """descricao_original, cadeia of products without one: each text once, with the last chain (lines: with their cadeia) in order."""
    own = lines.filter(F.col("sku_id").isNull() & (F.col("is_non_product") == F.lit(False)))
    return own.groupBy("descricao_original").agg(F.max("cadeia").alias("cadeia"))


def with_products(store: Store, lines: DataFrame, canonical: Callable[[DataFrame], DataFrame] | None, verdicts: DataFrame | None = None, bare: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Products, aliases and lines after the texts of new lines were resolved, and the id of each product that texts have; prices follow the products' units.

    lines: with the cadeia of their receipt. canonical: an injected step from texts (descricao_original, cadeia) to the
    canonical names that resolve() takes; without one only known texts get their product. bare: no line has a product yet,
    so units come with the texts and lines meet them only.
    """
    texts = settled(new_texts(lines))
    spark = lines.sparkSession
    none = spark.createDataFrame([], "descricao_original string, nome_canonico string, marca string, categoria string, unidade_base string, confianca double")
    aliases = store.sku_alias if store.sku_alias is not None else complete(spark.createDataFrame([], "sku_id long"), "sku_alias")
    found = settled(resolve(texts.select("descricao_original"), aliases, none if canonical is None else settled(canonical(texts)), store.sku_normalizado, verdicts))
    products, of_text = resolved_texts(found, store.sku_normalizado)
    products = settled(complete(products, "sku_normalizado"))
    units = products.select(F.col("id").alias("achado"), F.col("unidade_base").alias("unidade_do_sku"))
    if bare:
        lines = rc.priced_in(given_products(lines, of_text.join(units, "achado", "left"), "unidade_do_sku"), "unidade_do_sku")
    else:
        lines = rc.reprice(given_products(lines, of_text), products)
    return products, with_aliases(aliases, of_text), lines, of_text.select(F.col("achado").alias("id")).distinct()


def same_names(products: DataFrame, used: DataFrame) -> DataFrame | None:
    """The names of the products `used` (id) that other products have too; None if all names are single."""
    twice = settled(products.groupBy(normal_name(F.col("nome_canonico")).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"))
    if twice.isEmpty():
        return None
    own = settled(products.join(used, "id", "left_semi").join(twice, normal_name(F.col("nome_canonico")) == F.col("k"), "left_semi").select("nome_canonico").distinct())
    return None if own.isEmpty() else own


def summary(read: DataFrame, told: DataFrame, lines: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """One row per upload: key, duplicada, fatura_id, store, day, totals, and for new receipts their lines as they were stored."""
    # Lines meet their products, and then each other by receipt: names and lists need no further shuffle.
    product = products.filter("nome_canonico != ''").select(F.col("id").alias("sku_id"), "nome_canonico")
    shown = ("id", "descricao_original", "quantidade", "preco_unitario", "preco_liquido", "preco_por_base", "desconto_direto", "is_clearance", "is_non_product")
    named = lines.select("sku_id", "fatura_id", *shown).join(product, "sku_id", "left").select("fatura_id", "nome_canonico", *shown).repartition("fatura_id")
    last = F.max_by("nome_canonico", F.when(F.col("nome_canonico").isNotNull(), F.col("id"))).over(Window.partitionBy("fatura_id", "descricao_original"))
    named = named.withColumn("produto", F.coalesce(last, "descricao_original"))  # as receipts.named_lines() does
    line = F.struct(*shown[:2], "produto", *shown[2:])
    listed = named.groupBy("fatura_id").agg(F.array_sort(F.collect_list(line)).alias("itens"))  # the lines of one receipt
    rows = read.join(told, key).join(listed, "fatura_id", "left")
    none = lambda c: F.when(~F.col("duplicada"), c)
    return rows.select(
        key, "duplicada", "fatura_id", "loja_id", "cadeia", F.col("nome").alias("loja"), "metodo_extracao", "data_compra", "total_impresso", F.round("subtotal", 2).alias("subtotal_extraido"), "total_reconciliado",
        F.coalesce("desconto_global", F.lit(0.0)).alias("desconto_global"), F.col("bate").alias("extracao_bate"), (~F.col("bate") | (F.col("n_fora") > 0)).alias("needs_review"), "n_fora", "discrepancia", "convencao",
        none(F.coalesce("n_linhas", F.lit(0)).cast("long")).alias("n_itens"), none(F.col("itens")).alias("itens"),
    )


def ingest(catalog: Catalog, uploads: DataFrame, key: str = "ficheiro", again: Callable[[DataFrame, int], DataFrame] | None = None, canonical: Callable[[DataFrame], DataFrame] | None = None, verdicts: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Takes uploads (key, extracao_json, ABOUT) into the catalog's newest version; the new version's number and summary().

    Uploads without a receipt that can be read are left out of both. Stores, receipts and lines are only added to; aliases
    and products likewise, unless products of one name are merged: then lines, aliases and products are written anew. A user's
    messages get a note for each new receipt (utilizador null: none). Nothing changes if any step fails or if another writer
    commits first (catalog.Conflict).
    """
    spark, base = catalog.spark, catalog.manifest()["version"]
    store = catalog.read(base)
    about = [c.split()[0] for c in ABOUT.split(", ")]
    sent = uploads.select(key, "extracao_json", *(c.split()[0] if c.split()[0] in uploads.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ABOUT.split(", ")))
    # All of an extraction is kept once, by columns; what follows reads those it needs, and the lines meet their receipts' numbers once.
    # Hints are for corrections only, and of lines and prices one list is kept.
    both = F.zip_with("linhas", "precos", lambda x, y: F.struct(*(x[c].alias(c) for c in LINES), y["preco_unitario"].alias("unitario"), y["preco_liquido"].alias("preco_liquido")))
    whole = settled(read_well(sent, key, again, keep=about).withColumn("feitas", both).drop("linhas", "precos", "pista", "fora"))
    shops = whole.select("loja").distinct().withColumn("__no", F.col("loja"))
    stores, at = upsert_stores(shops.select("__no", *(F.col(f"loja.{c}").alias(c) for c in ("cadeia", "nome", "nif", "localizacao"))), store.loja)
    at = settled(at.select(F.struct("__no").alias("__no"), "loja_id", "cadeia", "nome"))  # within a struct, so that a missing store is a key too
    heads = whole.withColumn("n_linhas", F.size("feitas")).select(key, *about, "loja", "numero_fatura", *HEAD[1:], "subtotal", "convencao", "total_reconciliado", "discrepancia", "bate", "n_fora", "n_linhas")
    read = settled(heads.withColumn("__no", F.struct(F.col("loja").alias("__no"))).join(at, "__no").drop("__no"))
    fresh, told = stored_receipts(read, key, store.fatura)
    told = settled(told)
    numbers = fresh.select(F.col("chave_envio").alias(key), F.col("id").alias("fatura_id"), "antes_n_linhas")
    bills = whole.select(key, snapshot().alias("extracao_json")).join(fresh.withColumnRenamed("chave_envio", key), key).drop(key)
    # A line's id follows from the lines of the receipts before its own and its place, so lines aren't sorted for it.
    top = store.item.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    lines = whole.select(key, F.col("loja.cadeia").alias("cadeia"), "feitas").join(numbers, key).select("fatura_id", "cadeia", "antes_n_linhas", F.posexplode("feitas").alias("lugar", "linha"))
    lines = lines.select("fatura_id", "cadeia", (F.col("antes_n_linhas") + F.col("lugar") + (top + 1)).alias("id"), "linha.*")
    lines = settled(complete(stored_lines(lines, "id", "cadeia"), "item", "cadeia"))
    products, aliases, lines, used = with_products(store, lines, canonical, verdicts, bare=True)
    lines = complete(lines, "item")
    known = store.loja.select("id")
    added = {"loja": stores.join(known, "id", "left_anti"), "fatura": bills, "item": lines}
    replaced = {}
    shared = same_names(products, used)
    if shared is None:
        added |= {"sku_normalizado": products.join(store.sku_normalizado.select("id"), "id", "left_anti"), "sku_alias": newer(aliases, store.sku_alias)}
    else:
        lines = settled(lines)
        mapping = settled(identical_names(products, store.item.select("sku_id").unionByName(lines.select("sku_id")), names=shared))
        items, aliases, products = merge(store.item.unionByName(lines), aliases, products, mapping)
        del added["item"]
        replaced = {"item": items, "sku_alias": aliases, "sku_normalizado": products}
    note = rc.upload_note(F.col("loja.cadeia"), F.col("loja.nome"), F.col("data_compra"), F.col("total_impresso"), F.col("n_linhas"), F.col("bate"))
    own = read.filter("utilizador is not null").join(numbers, key)
    notes = own.select("fatura_id", "utilizador", F.lit("assistant").alias("papel"), note.alias("conteudo"), F.current_timestamp().cast("timestamp_ntz").alias("criado_em"))
    added["mensagem"] = with_ids(notes, store.mensagem, ["fatura_id"]).drop("fatura_id")
    stamp = F.current_timestamp().cast("timestamp_ntz")
    added = {n: f.withColumn("criado_em", stamp) if n in ("loja", "fatura") else f for n, f in added.items()}
    version = catalog.commit(base, added, replaced)
    now = catalog.read(version)
    return version, summary(read, told, now.item.filter(F.col("id") > top), now.sku_normalizado, key)


def reread(catalog: Catalog, again: DataFrame, canonical: Callable[[DataFrame], DataFrame] | None = None, verdicts: DataFrame | None = None) -> int:
    """Stored receipts (id, extracao_json) read again, as dml.reprocess() does; texts without a product are resolved; the new version's number."""
    base = catalog.manifest()["version"]
    store = catalog.read(base)
    fatura, items = reprocess(store.fatura, store.item, again, store.sku_alias, store.sku_normalizado)
    fatura, items = settled(fatura), settled(items)
    own = again.select(F.col("id").alias("fatura_id")).distinct()
    chains = store.fatura.select(F.col("id").alias("fatura_id"), "loja_id").join(own, "fatura_id", "left_semi").join(store.loja.select(F.col("id").alias("loja_id"), "cadeia"), "loja_id").select("fatura_id", "cadeia")
    again_read = items.join(own, "fatura_id", "left_semi").select(*items.columns).join(chains, "fatura_id", "left")
    products, aliases, lines, _ = with_products(store, again_read, canonical, verdicts)
    kept = items.join(own, "fatura_id", "left_anti").select(*items.columns)
    added = {"sku_normalizado": products.join(store.sku_normalizado.select("id"), "id", "left_anti"), "sku_alias": newer(aliases, store.sku_alias)}
    return catalog.commit(base, added, {"fatura": fatura, "item": kept.unionByName(complete(lines, "item"))})


def newer(aliases: DataFrame, old: DataFrame) -> DataFrame:
    """Aliases whose text isn't among the old ones."""
    k = fold(F.col("descricao_original"))
    return aliases.withColumn("k", k).join(old.select(k.alias("k")), "k", "left_anti").drop("k")


def first_version(catalog: Catalog, store: Store) -> int:
    """A catalog's first version, of a store's relations."""
    return catalog.commit(0, store.tables())


__all__ = ["ABOUT", "first_version", "ingest", "judged", "read_well", "with_products"]
