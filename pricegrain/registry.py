"""The registered queries over the driver's tables, and the SQL that must give the same rows.

Arguments are fixed here so that both sides agree; a period always has both ends, so no result depends on today.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, units
from .operators import dml, median, receipts, resolve, search, star, upload
from .plans import admin, explorer, purchases
from .sources.adapter import description, items, store, table
from .sources.catalog import Catalog
from .sources.tables import Store, shared_folder
from .streaming import recurrence

START, END = "1996-01-01", "1999-12-31"
SKU = 25
#: Means of prices fall on ties of rounding, where sums in another order differ; this much off them they don't.
SHIFT = 1.3e-7
CATEGORIES = ("Frutas e Legumes", "Pão e Pastelaria", "TALHO", "Peixe fresco", "Laticínios", "Congelados", "Bebidas", "Ovos", "Higiene", "")


def doubles(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, which both engines print alike."""
    return frame.select(*(F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`") for n, t in frame.dtypes))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as extracted receipt lines, by position."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    value = F.round(F.col("l_extendedprice") / 1000, 0)
    return rows.select(F.col("l_orderkey").alias("fatura_id"), pos.alias("pos"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("descricao_original"), value.alias("valor"), F.round(F.col("l_discount") * 100, 0).alias("desconto_direto"), F.col("l_quantity").alias("quantidade"), (F.col("l_linenumber") * 1.0).alias("preco_unitario"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fatura_id"), F.round(F.col("o_totalprice") / 1000, 0).alias("total_impresso"), F.lit(0.0).alias("desconto_global"), F.lit(0.0).alias("iva"))


def q_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = purchases.receipt_details(store(spark, sf_dir), "BUILD", "1997-05-28")
    rows = found.select("loja", "cadeia", "data", "total", "em_revisao", "metodo_extracao", F.posexplode("itens").alias("pos", "i"))
    return doubles(rows.select("loja", "cadeia", "data", "total", "em_revisao", "metodo_extracao", F.col("pos").cast("long").alias("pos"), "i.produto", "i.descricao_original", "i.preco"))


def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some prices are 0, which must not move a median."""
    s = store(spark, sf_dir)
    s = replace(s, item=s.item.withColumn("preco_por_base", F.when(F.col("quantidade") == 1, 0.0).otherwise(F.col("preco_por_base"))))
    return doubles(admin.price_outliers(s, 2).select("sku_id", "nome_canonico", "unidade_base", "fatura_id", "descricao_original", "quantidade", "preco_liquido", "cadeia", F.date_format("data_compra", "yyyy-MM-dd").alias("data"), "preco_por_base", "mediana", "desvio"))


def q_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.similar_products(store(spark, sf_dir), "widgt").select("id", "nome_canonico", F.round("score", 6).alias("score"))


def indexed(spark: SparkSession, sf_dir: str) -> Store:
    """The store with posting lists of its descriptions and names, written in the shared folder."""
    s = store(spark, sf_dir)
    folder = f"{shared_folder(spark)}/indice-{uuid.uuid4().hex}"
    search.write_index(search.search_index(s.item, s.sku_normalizado), folder)
    return replace(s, indice=search.read_index(spark, folder))


def q_found_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a term, found in posting lists, by product and description."""
    return star.match_product(indexed(spark, sf_dir), "et 2").groupBy(F.coalesce("sku_id", F.lit(-1)).alias("sku_id"), "descricao_original").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("loja_id").alias("n_lojas"))


def q_found_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.similar_products(indexed(spark, sf_dir), "plte").select("id", "nome_canonico", F.round("score", 6).alias("score"))


def q_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price per unit of each chain and of all lines: few groups of very many rows, so the middle is selected by counting."""
    s = store(spark, sf_dir)
    rows = star.fact_items(s).filter("preco_por_base > 0").select(F.explode(F.array(F.lit("*"), F.col("cadeia"))).alias("cadeia"), "preco_por_base")
    return median.medians(rows, "cadeia", "preco_por_base")


def q_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).item.select("descricao_original").distinct()
    return rows.select("descricao_original", units.pack_format(F.col("descricao_original")).alias("f")).select("descricao_original", "f.unidade_base", "f.formato_valor")


def q_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    priced = receipts.reprice(s.item.withColumn("linha_peso", F.lit(None).cast("string")), s.sku_normalizado)
    return priced.groupBy(F.coalesce("sku_id", F.lit(-1)).alias("sku_id")).agg(F.count("preco_por_base").alias("n"), F.min("preco_por_base").alias("menor"), F.max("preco_por_base").alias("maior"))


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with each priced line."""
    found = receipts.reconcile(lines(spark, sf_dir), totals(spark, sf_dir), "fatura_id")
    return found.select("*", F.explode("itens").alias("i")).select(*(c for c in found.columns if c != "itens"), F.col("i.pos").cast("long").alias("pos"), "i.preco_unitario", "i.preco_liquido")


def q_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.wrong_lines(lines(spark, sf_dir)).select("fatura_id", F.col("pos").cast("long").alias("pos"), "quantidade", "preco_unitario", "valor", "esperado")


def q_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return receipts.hint(rows, receipts.reconcile(rows, totals(spark, sf_dir), "fatura_id").select("fatura_id", "discrepancia"), "fatura_id")


def q_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("descricao_original", F.when(F.col("pos") % 3 == 1, "POUPANCA").when(F.col("pos") % 5 == 2, "0,816 kg 1,70 EUR/kg").otherwise(F.col("descricao_original")))
    return receipts.fold_lines(rows, "fatura_id").select("fatura_id", F.col("pos").cast("long").alias("pos"), "descricao_original", "linha_peso", "valor", "desconto_direto")


def q_merge_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return dml.identical_names(s.sku_normalizado, s.item)


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders, those that are no duplicates of orders with an even key or of each other; days are years, so that many agree."""
    rows = store(spark, sf_dir).fatura.select(
        "id",
        "loja_id",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("F"), (F.col("id") % 40).cast("string"))).alias("numero_fatura"),
        F.when(F.col("id") % 11 != 0, F.date_trunc("year", "data_compra")).alias("data_compra"),
        F.when(F.col("id") % 13 != 0, F.floor(F.col("total_impresso") / 50_000).cast("decimal(10,2)")).alias("total_impresso"),
    )
    return dml.new_receipts(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).select("id", "loja_id", "numero_fatura")


def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without a product, by their own parts' names, against the products that lines already have."""
    s = store(spark, sf_dir)
    texts = s.item.filter("sku_id is null").select("descricao_original")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), description(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("descricao_original"))
    named = part.join(s.sku_normalizado, "id").select("descricao_original", F.initcap("nome_canonico").alias("nome_canonico"), "marca", "categoria", "unidade_base", "formato_valor", F.lit(0.9).alias("confianca"))
    known = s.sku_normalizado.join(s.item.select(F.col("sku_id").alias("id")), "id", "left_semi")
    aliases = s.item.filter("sku_id is not null").select("descricao_original", "sku_id")
    return resolve.resolve(texts, aliases, named, known).select("descricao_original", "via", "sku_id", "nome_canonico", "representante")


def q_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with a snapshot of their lines, as they were extracted."""
    read = lines(spark, sf_dir)
    line = F.struct("pos", "descricao_original", "valor", "desconto_direto", "quantidade", "preco_unitario")
    told = read.groupBy("fatura_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("itens"))).alias("extracao_json"))
    gaps = receipts.reconcile(read, totals(spark, sf_dir), "fatura_id").select("fatura_id", "discrepancia", (~F.col("bate")).alias("needs_review"))
    found = receipts.diagnosis(told.join(gaps, "fatura_id"), "fatura_id")
    return found.select("fatura_id", "discrepancia", F.col("pista.tipo").alias("tipo"), F.col("pista.linha").alias("linha"), F.size(F.coalesce("linhas_inconsistentes", F.array())).cast("long").alias("n_linhas"), F.coalesce(F.get("linhas_inconsistentes", F.lit(0))["pos"].cast("long"), F.lit(-1)).alias("primeira"))


def q_named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each receipt's texts by the product names that they go by."""
    s = store(spark, sf_dir)
    return receipts.named_lines(s.item.select("fatura_id", "descricao_original").distinct(), s.item, s.sku_normalizado)


def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by section, with categories of a shop."""
    s = store(spark, sf_dir)
    kinds = F.array(*map(F.lit, CATEGORIES))
    named = s.sku_normalizado.withColumn("categoria", F.get(kinds, (F.col("id") % len(CATEGORIES)).cast("int")))
    s = replace(s, sku_normalizado=named, item=items(spark, sf_dir, described=False))
    return doubles(explorer.by_section(explorer.products(s, None, None, None, ordered=False))).withColumn("n", F.col("n").cast("long"))


def q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_palavras"), text.section(F.col("text")).alias("seccao"), F.length(text.normal_name(F.col("text"))).cast("long").alias("n_letras"))


def q_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of which some carry the names of supermarkets and pharmacies."""
    chain = F.when(F.col("id") % 4 == 0, "Continente").when(F.col("id") % 4 == 1, "FARMÁCIA Central").otherwise(F.col("cadeia"))
    named = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Loja Pingo Doce "), "nome")).otherwise(F.col("nome"))
    return dml.classify_stores(store(spark, sf_dir).loja.withColumns({"cadeia": chain, "nome": named})).groupBy("cadeia", "tipo").agg(F.count(F.lit(1)).alias("n"))


def q_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders uploaded as extractions, every fifth twice, into a catalog that has a quarter of them and most of the stores.

    A row for each line as the new version has it; one for each duplicate, with the number of the receipt that it equals.
    """
    s, numbered = store(spark, sf_dir), F.concat(F.lit("F"), F.col("id").cast("string"))
    s = replace(s, sku_normalizado=s.sku_normalizado.withColumn("nome_canonico", F.concat_ws(" ", "nome_canonico", F.col("id").cast("string"))))  # no two of one name
    shops = s.loja.filter("id % 3 != 0")
    bills = s.fatura.filter("id % 4 = 0").join(shops.select(F.col("id").alias("loja_id")), "loja_id", "left_semi").withColumn("numero_fatura", numbered)
    aliases = s.sku_normalizado.filter("id % 17 != 0").select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("descricao_original"), F.col("id").alias("sku_id"))
    catalog = Catalog(spark, f"{shared_folder(spark)}/catalogo-{uuid.uuid4().hex}")
    upload.first_version(catalog, Store(shops, s.sku_normalizado, bills, s.item.limit(0).drop("id").withColumn("id", F.lit(None).cast("long")), aliases))
    line = F.struct("pos", "descricao_original", "valor", "desconto_direto", "quantidade", "preco_unitario")
    listed = lines(spark, sf_dir).groupBy("fatura_id").agg(F.array_sort(F.collect_list(line)).alias("itens"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fatura_id"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("total_impresso"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("data_compra"))
    told = orders.join(s.loja.select("id", F.struct("cadeia", "nome").alias("loja")), "id").join(listed, "fatura_id")
    told = told.select("fatura_id", F.to_json(F.struct("loja", F.concat(F.lit("F"), F.col("fatura_id").cast("string")).alias("numero_fatura"), "data_compra", "total_impresso", "itens")).alias("extracao_json"))
    sent = F.when(F.col("fatura_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))  # each order's lines are gathered once
    files = told.select("fatura_id", "extracao_json", F.explode(sent).alias("vez")).select(F.concat("vez", F.col("fatura_id").cast("string")).alias("ficheiro"), "extracao_json")
    named = lambda texts: texts.select("descricao_original", F.concat(F.lit("Novo"), "descricao_original").alias("nome_canonico"), F.lit(None).cast("string").alias("marca"), F.col("cadeia").alias("categoria"), F.lit("un").alias("unidade_base"), F.lit(1.0).alias("confianca"))
    version, found = upload.ingest(catalog, files, canonical=named)
    bill = catalog.read(version).fatura.select(F.col("id").alias("fatura_id"), "numero_fatura")
    rows = found.join(bill, "fatura_id").select("ficheiro", "numero_fatura", "duplicada", "cadeia", "loja", "data_compra", "total_impresso", "total_reconciliado", "discrepancia", "convencao", "needs_review", "n_fora", F.coalesce("n_itens", F.lit(0).cast("long")).alias("n_itens"), F.explode_outer("itens").alias("i"))
    return doubles(rows.select(*rows.columns[:-1], "i.descricao_original", "i.produto", "i.quantidade", "i.preco_unitario", "i.preco_liquido", "i.preco_por_base", "i.desconto_direto"))


#: Starts of receipt texts that hold abbreviations, and ends that name a chain.
SHORT, CHAINS = ("BOL", "qj", "IOG", "C/ MANT", "P/", "CEREAIS", "Emb", "CONSERVACAO", "LOMB S/", "un", "XBOL"), ("", "", "Continente", "PINGO DOCE", "lidl")


def q_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's habitual products of the 60 days before."""
    return doubles(recurrence.habitual_by_day(store(spark, sf_dir)))


def q_outlier_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with outliers and their lines, each in its place."""
    found = admin.outliers_by_product(admin.price_outliers(store(spark, sf_dir), 2))
    rows = found.select("sku_id", "nome_canonico", "n", "maior_desvio", F.posexplode("itens").alias("lugar", "i"))
    return doubles(rows.select("sku_id", "nome_canonico", "n", "maior_desvio", F.col("lugar").cast("long").alias("lugar"), "i.fatura_id", "i.preco_por_base", "i.desvio"))


def q_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by product after all lines of a text were given another."""
    s = store(spark, sf_dir)
    words = s.item.agg(F.min("descricao_original")).first()[0]
    return dml.repoint(s.item, words.lower(), SKU).groupBy(F.coalesce("sku_id", F.lit(-1)).alias("sku_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("descricao_original").alias("textos"))


def q_dissociate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and aliases by product after a text was taken from its product."""
    s = store(spark, sf_dir)
    aliases = s.item.filter("sku_id is not null").select("descricao_original", "sku_id").distinct()
    words = s.item.filter(F.col("sku_id") == SKU).agg(F.min("descricao_original")).first()[0]
    items, aliases = dml.dissociate(s.item, aliases, SKU, words)
    count = lambda rows, name: rows.groupBy(F.lit(name).alias("tabela"), F.coalesce("sku_id", F.lit(-1)).alias("sku_id")).agg(F.count(F.lit(1)).alias("n"))
    return count(items, "item").unionByName(count(aliases, "alias"))


def q_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices per unit of each receipt after the first line's quantity was corrected to 3."""
    items = store(spark, sf_dir).item.withColumn("id", F.col("id.l_orderkey") * 10 + F.col("id.l_linenumber"))
    changed = dml.edit_quantity(items, items.agg(F.min("id")).first()[0], 3)
    return doubles(changed.groupBy("fatura_id").agg(F.sum("quantidade").alias("quantidade"), F.min("preco_por_base").alias("menor"), F.max("preco_por_base").alias("maior")))


def q_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after each receipt but one in fifty was deleted: receipts, lines, verdicts, products and aliases."""
    s = store(spark, sf_dir)
    aliases = s.item.filter("sku_id is not null").select("descricao_original", "sku_id").distinct()
    left = dml.delete_receipts(s.fatura, s.item, s.revisao, s.sku_normalizado, aliases, s.fatura.filter("id % 50 != 0"))
    key = {"fatura": "loja_id", "item": "sku_id", "revisao": "fatura_id", "sku_normalizado": "id", "sku_alias": "sku_id"}
    rows = [left[t].groupBy(F.lit(t).alias("tabela"), F.coalesce(F.col(k), F.lit(-1)).cast("long").alias("chave")).agg(F.count(F.lit(1)).alias("n")) for t, k in key.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])


def q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by user after one was added, added again in capitals, and another forgotten."""
    facts = store(spark, sf_dir).perfil
    gone = facts.filter("utilizador = '3'").agg(F.min("fato")).first()[0]
    facts = dml.remember(dml.remember(facts, "3", "  Gosta de café "), "3", "GOSTA DE CAFE")
    return dml.forget(facts, "3", gone.upper()).groupBy("utilizador").agg(F.count(F.lit(1)).alias("n"), F.min("fato").alias("primeiro"), F.max("fato").alias("ultimo"))


def q_needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lines(spark, sf_dir)
    return receipts.needs_review(receipts.reconcile(read, totals(spark, sf_dir), "fatura_id"), read, "fatura_id")


def chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A shopping list of all parts, and the categories of two in three of their names."""
    part = table(spark, sf_dir, "part")
    kinds = F.get(F.array(*map(F.lit, CATEGORIES)), (F.length("p_name") % len(CATEGORIES)).cast("int"))
    return part.select(F.col("p_name").alias("produto"), F.col("p_retailprice").alias("preco")), part.filter("length(p_name) % 3 != 0").select(F.col("p_name").alias("produto"), kinds.alias("categoria"))


def q_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.cart(*chosen(spark, sf_dir)).select("produto", F.col("preco").cast("double").alias("preco"), "categoria", "seccao")


def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions by method: off by 0 to 2, a few of them failed."""
    k = F.col("o_orderkey")
    read = F.when(k % 11 != 0, F.col("o_totalprice").cast("decimal(14,2)") + k % 5 - 2)
    results = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metodo"), F.col("o_totalprice").cast("decimal(14,2)").alias("total"), read.alias("lido"), F.when(k % 11 == 0, "falhou").alias("erro"))
    return doubles(admin.score_board(results, "metodo"))


def q_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt texts with their abbreviations written out, and without the chains in them."""
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", pick(SHORT), "p_name", pick(CHAINS)).alias("texto"))
    return rows.select(F.col("p_partkey").alias("id"), text.expand_abbreviations(F.col("texto")).alias("extenso"), text.split_chain(F.col("texto")).alias("c")).select("id", "extenso", "c.sem_cadeia", "c.cadeia_token")


def q_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = admin.quality(store(spark, sf_dir), "cadeia")
    return found.select("grupo", admin.traffic_light(F.col("reconciliadas"), F.col("n")).alias("leitura"), admin.traffic_light(F.col("ok"), F.col("revistas")).alias("revisao"))


def q_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all explored products those whose names hold a text, and what they cost together."""
    s = replace(store(spark, sf_dir), item=items(spark, sf_dir, described=False))
    found = explorer.search(explorer.products(s, None, None, None, ordered=False), "pl%te")
    plain = explorer.search(explorer.products(s, None, None, None, ordered=False), " PLATE ")
    total = lambda rows, q: doubles(rows.agg(F.lit(q).alias("q"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_gasto"), F.lit(0)).cast("double").alias("total")))
    return total(found, "pl%te").unionByName(total(plain, "plate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "carregar_faturas": q_upload,
    "ultima_compra": lambda s, d: doubles(purchases.last_purchase(store(s, d), "widget")),
    "comparar_lojas": lambda s, d: purchases.compare_stores(store(s, d), "red plate"),
    "historico_preco": lambda s, d: doubles(purchases.price_history(store(s, d), "brand#25", "1998-01-01")),
    "total_gasto": lambda s, d: doubles(purchases.total_spent(store(s, d), "ring", "BUILDING", START, END)),
    "total_tudo": lambda s, d: doubles(purchases.total_spent(store(s, d), "tudo", None, START, END)),
    "listar_item": lambda s, d: doubles(purchases.list_purchases(store(s, d), "1997-03-01", "1997-03-31", "bolt", "machin")),
    "listar_produto": lambda s, d: doubles(purchases.list_purchases(store(s, d), START, END, None, None, "produto")),
    "mais_barato": lambda s, d: purchases.cheapest_products(store(s, d), "plate"),
    "detalhe_fatura": q_receipt,
    "habituais": lambda s, d: doubles(purchases.habitual_products(store(s, d), 2, START, END)),
    "habituais_60d": lambda s, d: doubles(purchases.habitual_lately(store(s, d), "2000-06-30")),
    "meses": lambda s, d: explorer.months(store(s, d)),
    "explorar_produtos": lambda s, d: doubles(explorer.products(store(s, d), "pl%te", "1998-03")),
    "explorar_historico": lambda s, d: doubles(explorer.product_history(store(s, d), SKU)).withColumn("normal", F.round("normal", 6)),
    "explorar_por_loja": lambda s, d: explorer.product_stores(store(s, d), SKU),
    "estatisticas_produto": lambda s, d: explorer.product_statistics(store(s, d)).withColumns({"n": F.col("n").cast("long")} | {c: F.round(F.col(c) + SHIFT, 5) for c in ("media", "total", "poupanca", "tendencia", "pouparia")}),
    "sku_lista": lambda s, d: doubles(admin.product_list(store(s, d), "ring", 500)),
    "sku_descricoes": lambda s, d: admin.product_descriptions(store(s, d), SKU),
    "descricoes_livres": lambda s, d: admin.free_descriptions(store(s, d), "hot"),
    "faturas_lista": lambda s, d: doubles(admin.receipt_list(store(s, d))).withColumn("data_compra", star.day()),
    "faturas_pendentes": lambda s, d: doubles(admin.receipt_list(store(s, d), "pendente")).withColumn("data_compra", star.day()),
    "qualidade_cadeia": lambda s, d: admin.quality(store(s, d), "cadeia"),
    "qualidade_origem": lambda s, d: admin.quality(store(s, d), "origem_captura"),
    "qualidade_metodo": lambda s, d: admin.quality(store(s, d), "metodo_extracao"),
    "qualidade_modelo": lambda s, d: admin.quality_by_model(store(s, d)),
    "outliers_preco": q_outliers,
    "custos_total": lambda s, d: doubles(admin.costs(store(s, d))),
    "custos_contexto": lambda s, d: doubles(admin.costs(store(s, d), "contexto")),
    "custos_modelo": lambda s, d: doubles(admin.costs(store(s, d), "modelo")),
    "sugestoes_merge": lambda s, d: admin.merge_suggestions(store(s, d), 0.6),
    "diagnostico": q_diagnosis,
    "nomes_fatura": q_named_lines,
    "perfil": lambda s, d: admin.facts_of(store(s, d), "3"),
    "merge_identicos": q_merge_identical,
    "fuzzy_alvo": q_fuzzy,
    "procurar_linhas": q_found_lines,
    "procurar_nomes": q_found_names,
    "mediana_cadeia": q_median,
    "expandir_alvo": lambda s, d: doubles(purchases.total_spent(store(s, d), "bebida", None, START, END)),
    "formato": q_format,
    "preco_base": q_price,
    "reconciliar": q_reconcile,
    "validar_linhas": q_wrong,
    "pista": q_hint,
    "dobrar_linhas": q_fold_lines,
    "resolver_sku": q_resolve,
    "dedup": q_dedup,
    "orfaos": lambda s, d: admin.orphans(store(s, d)).select("id", "nome_canonico"),
    "por_resolver": lambda s, d: admin.unresolved(store(s, d)),
    "chat_ultimas": lambda s, d: admin.last_messages(store(s, d), 3),
    "seccoes": q_sections,
    "palavras": q_text,
    "tipos_loja": q_stores,
    "habituais_por_dia": q_by_day,
    "outliers_por_produto": q_outlier_products,
    "recolar_texto": q_repoint,
    "dissociar_texto": q_dissociate,
    "corrigir_quantidade": q_quantity,
    "apagar_faturas": q_delete,
    "guardar_factos": q_facts,
    "rever_faturas": q_needs_review,
    "carrinho": q_cart,
    "carrinho_total": lambda s, d: explorer.cart_total(chosen(s, d)[0]),
    "comparar_extracoes": q_board,
    "abreviaturas": q_short,
    "semaforo": q_lights,
    "pesquisa_explorador": q_listed,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# What the adapter does, in SQL.
LOJA = "loja AS (SELECT c_custkey AS id, c_mktsegment AS cadeia, c_name AS nome FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SKU_SQL = """sku AS (SELECT p_partkey AS id, p_name AS nome_canonico, CASE WHEN p_size <= 25 THEN split_part(p_name, ' ', 2) END AS nome_simplificado, p_brand AS marca, p_type AS categoria,
    CASE p_size % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' ELSE 'un' END AS unidade_base, p_size / 10 AS formato_valor FROM part)"""
FATURA = """fatura AS (SELECT o_orderkey AS id, o_custkey AS loja_id, o_orderdate AS data_compra, CAST(o_totalprice AS DECIMAL(12,2)) AS total_impresso, o_orderstatus = 'P' AS needs_review,
    CAST(o_orderkey % 7 - 3 AS DECIMAL(10,2)) AS discrepancia, o_orderpriority AS origem_captura, CASE WHEN o_orderkey % 2 = 0 THEN 'vlm' ELSE 'ocr_llm' END AS metodo_extracao,
    CASE WHEN o_orderkey % 5 > 0 THEN 'modelo-' || (o_orderkey % 5) END AS modelo FROM orders)"""
ITEM = """item AS (SELECT struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS id, l_orderkey AS fatura_id, CASE WHEN l_partkey % 17 != 0 THEN l_partkey END AS sku_id,
    upper(p_name) || CASE l_partkey % 4 WHEN 0 THEN ' ' || (p_size * 10) || 'G' WHEN 1 THEN ' ' || (p_size % 6 + 2) || 'X' || p_size || 'CL' WHEN 2 THEN ' ' || p_size || 'UN' ELSE '' END AS descricao_original,
    l_quantity AS quantidade, CASE WHEN l_quantity < 10 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS preco_unitario,
    CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) AS preco_liquido,
    CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS desconto_direto,
    CASE WHEN l_quantity < 48 THEN floor(l_extendedprice / l_quantity * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS preco_por_base,
    l_returnflag = 'R' AS is_clearance, l_returnflag = 'N' AND l_linestatus = 'F' AS is_non_product FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BASE = f"""WITH {LOJA}, {SKU_SQL}, {FATURA}, {ITEM}, base AS (SELECT i.id AS item_id, i.fatura_id, i.sku_id, i.descricao_original, i.preco_liquido, i.desconto_direto, i.preco_por_base, i.is_clearance, i.is_non_product,
    l.id AS loja_id, l.cadeia, l.nome AS loja, f.data_compra, f.needs_review, s.nome_canonico, s.nome_simplificado, s.marca, s.categoria, s.unidade_base, coalesce(s.nome_canonico, i.descricao_original) AS produto, strftime(f.data_compra, '%Y-%m-%d') AS data
    FROM item i JOIN fatura f ON f.id = i.fatura_id JOIN loja l ON l.id = f.loja_id LEFT JOIN sku s ON s.id = i.sku_id)"""
OK = "NOT is_non_product AND NOT needs_review"
PLAIN = f"{OK} AND NOT is_clearance AND preco_por_base IS NOT NULL"
SHOWN = f"{OK} AND preco_por_base IS NOT NULL AND nome_canonico IS NOT NULL"
PERIOD = f"CAST(data_compra AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
VERDICTS = """revisao AS (SELECT o_orderkey * 2 AS id, o_orderkey AS fatura_id, CASE WHEN o_orderkey % 4 = 0 THEN 'erro' ELSE 'ok' END AS veredicto FROM orders WHERE o_orderkey % 3 != 0
    UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, 'ok' FROM orders WHERE o_orderkey % 3 != 0 AND o_orderkey % 5 = 0), veredictos AS (SELECT fatura_id, arg_max(veredicto, id) AS veredicto FROM revisao GROUP BY 1)"""
LINES = """linhas AS (SELECT l_orderkey AS fatura_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, 'P' || l_partkey AS descricao_original,
    round(l_extendedprice / 1000, 0) AS valor, round(l_discount * 100, 0) AS desconto_direto, l_quantity AS quantidade, CAST(l_linenumber AS DOUBLE) AS preco_unitario FROM lineitem)"""
RECONCILED = f"""WITH {LINES}, somas AS (SELECT fatura_id, sum(valor) AS bruto, sum(abs(desconto_direto)) AS desc_, round(any_value(o_totalprice) / 1000, 0) AS total FROM linhas JOIN orders ON o_orderkey = fatura_id GROUP BY 1),
    conv AS (SELECT *, CASE WHEN abs(bruto - desc_ - total) < abs(bruto - total) THEN 'B' ELSE 'A' END AS convencao FROM somas),
    feito AS (SELECT fatura_id, bruto AS subtotal, convencao, CASE convencao WHEN 'B' THEN bruto - desc_ ELSE bruto END AS total_reconciliado, CASE convencao WHEN 'B' THEN bruto - desc_ ELSE bruto END - total AS discrepancia FROM conv)"""


PACKS = """partes AS (SELECT DISTINCT descricao_original AS t, regexp_extract(descricao_original, '(\\d+)X(\\d+)CL', 1) AS a, regexp_extract(descricao_original, '(\\d+)X(\\d+)CL', 2) AS b, regexp_extract(descricao_original, '(\\d+)G$', 1) AS g, regexp_extract(descricao_original, '(\\d+)UN$', 1) AS u FROM item),
    embalagens AS (SELECT t AS descricao_original, CASE WHEN a != '' THEN 'L' WHEN g != '' THEN 'kg' ELSE 'un' END AS unidade_base, CASE WHEN a != '' THEN floor(CAST(a AS DOUBLE) * (CAST(b AS DOUBLE) / 100) * 1000 + 0.5::DOUBLE) / 1000
    WHEN g != '' THEN floor(CAST(g AS DOUBLE) / 1000 * 1000 + 0.5::DOUBLE) / 1000 WHEN u != '' THEN CAST(u AS DOUBLE) ELSE 1 END AS formato_valor FROM partes)"""
HINTS = """x AS (SELECT f.fatura_id, f.discrepancia AS gap, arg_min(descricao_original, pos) FILTER (abs(abs(valor) - abs(gap)) <= 0.02) AS v, arg_min(descricao_original, pos) FILTER (desconto_direto != 0 AND abs(abs(desconto_direto) - abs(gap)) <= 0.02) AS d
    FROM feito f JOIN linhas l USING (fatura_id) WHERE f.discrepancia != 0 GROUP BY 1, 2), pistas AS (SELECT fatura_id, CASE WHEN v IS NOT NULL THEN CASE WHEN gap > 0 THEN 'DUPLICADO' ELSE 'FALTAR' END WHEN d IS NOT NULL THEN 'DESCONTO' WHEN gap > 0 THEN 'ACIMA' ELSE 'ABAIXO' END AS tipo,
    coalesce(v, d) AS linha, abs(gap) AS diferenca FROM x)"""


def written_out(x: str) -> str:
    """The text x with its abbreviations written out, one after another."""
    for pattern, meaning in text.ABBREVIATIONS:
        x = f"regexp_replace({x}, '(?i)\\b{pattern}" + ("\\s*" if pattern.endswith("/") else "\\b") + f"', '{meaning}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def section_sql(folded: str) -> str:
    """The section of a folded text, by the parts of text.SECTIONS in their order."""
    cases = " ".join(f"WHEN {' OR '.join(f'contains({folded}, {p!r})' for p in parts)} THEN '{name}'" for name, parts in text.SECTIONS)
    return f"CASE {cases} WHEN {folded} = '' THEN 'Outros' ELSE 'Mercearia' END"


def matches(term: str) -> str:
    return "(" + " OR ".join(f"coalesce(strip_accents(lower({c})) LIKE '%{term}%', FALSE)" for c in ("nome_canonico", "marca", "categoria", "descricao_original")) + ")"


def quality_sql(by: str) -> str:
    return f"""WITH {LOJA}, {FATURA}, {VERDICTS} SELECT coalesce({by}, '—') AS grupo, count(*) AS n, count(*) FILTER (NOT needs_review) AS reconciliadas, round(avg(abs(CAST(discrepancia AS DOUBLE))), 3) AS disc_media,
        count(veredicto) AS revistas, count(*) FILTER (veredicto = 'ok') AS ok, count(*) FILTER (veredicto = 'erro') AS erro FROM fatura f JOIN loja l ON l.id = f.loja_id LEFT JOIN veredictos v ON v.fatura_id = f.id GROUP BY 1"""


def receipts_sql(where: str) -> str:
    return f"""WITH {LOJA}, {FATURA}, {VERDICTS} SELECT f.id, strftime(data_compra, '%Y-%m-%d') AS data_compra, cadeia, nome AS loja, CAST(total_impresso AS DOUBLE) AS total_impresso, needs_review, metodo_extracao, veredicto,
        (SELECT count(*) FROM lineitem WHERE l_orderkey = f.id) AS n_itens FROM fatura f JOIN loja l ON l.id = f.loja_id LEFT JOIN veredictos v ON v.fatura_id = f.id {where} ORDER BY f.id DESC LIMIT 100"""


def habitual_sql(start: str, end: str) -> str:
    return f"""{BASE} SELECT min(nome) AS produto, max(categoria) AS categoria, count(DISTINCT fatura_id) AS idas, count(DISTINCT strftime(data_compra, '%Y-%m')) AS meses, count(*) AS unidades,
        CAST(sum(preco_liquido) AS DOUBLE) AS total, CAST(arg_max(preco_liquido, struct_pack(x := data_compra, y := item_id)) AS DOUBLE) AS ultimo_preco
        FROM (SELECT *, coalesce(nome_simplificado, nome_canonico, descricao_original) AS nome FROM base WHERE {OK} AND CAST(data_compra AS DATE) BETWEEN DATE '{start}' AND DATE '{end}')
        GROUP BY lower(nome) HAVING idas >= 2 ORDER BY idas DESC, meses DESC, unidades DESC, produto LIMIT 40"""


def spelled_sql(term: str) -> str:
    ratio = f"max(1 - levenshtein('{term}', t) / greatest({len(term)}, length(t)))"
    return f"""WITH {SKU_SQL}, p AS (SELECT id, nome_canonico, unnest(list_append(string_split(nome_canonico, ' '), replace(nome_canonico, ' ', ''))) AS t FROM sku)
        SELECT id, nome_canonico, round({ratio}, 6) AS score FROM p GROUP BY ALL HAVING {ratio} >= 0.7::DOUBLE"""


def total_sql(where: str, alvo: str, loja: str) -> str:
    return f"{BASE} SELECT '{alvo}' AS alvo, {loja} AS loja, '{START}' AS periodo_inicio, '{END}' AS periodo_fim, CAST(coalesce(sum(preco_liquido), 0) AS DOUBLE) AS total, count(*) AS n_itens FROM base WHERE {OK} AND {PERIOD} AND {where}"


def oracle_sql() -> dict[str, str]:
    newest = "data_compra DESC, item_id DESC"
    folded = "lower(descricao_original)"
    drinks = " OR ".join(matches(t) for t in text.SYNONYMS["bebida alcoolica"])
    return {
        "carregar_faturas": f"""WITH {LINES}, {LOJA}, {SKU_SQL}, base AS (SELECT o_orderkey AS k, o_custkey AS loja_id, o_totalprice AS total, o_orderkey % 4 = 0 AND o_custkey % 3 != 0 AS antiga, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS data_compra FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
            somas AS (SELECT fatura_id AS k, sum(valor) AS bruto, sum(abs(desconto_direto)) AS desc_, count(*) AS n_itens, count(*) FILTER (quantidade >= 2 AND preco_unitario > 0 AND abs(quantidade * preco_unitario - abs(valor)) > 0.02) AS n_fora FROM linhas GROUP BY 1),
            julgadas AS (SELECT *, CASE WHEN abs(bruto - desc_ - total) < abs(bruto - total) THEN 'B' ELSE 'A' END AS convencao FROM base JOIN somas USING (k)),
            feitas AS (SELECT *, CASE convencao WHEN 'B' THEN bruto - desc_ ELSE bruto END AS total_reconciliado, floor((CASE convencao WHEN 'B' THEN bruto - desc_ ELSE bruto END - total) * 100 + 0.5::DOUBLE) / 100 AS discrepancia FROM julgadas),
            envios AS (SELECT *, 'a' || k AS ficheiro, antiga AS duplicada FROM feitas UNION ALL SELECT *, 'b' || k, TRUE FROM feitas WHERE k % 5 = 0),
            itens AS (SELECT l.*, CASE WHEN substr(descricao_original, 2)::BIGINT % 17 = 0 THEN 'Novo' || descricao_original ELSE nome_canonico || ' ' || s.id END AS produto, CASE WHEN s.id % 17 = 0 THEN 'un' ELSE unidade_base END AS unidade FROM linhas l JOIN sku s ON s.id = substr(descricao_original, 2)::BIGINT)
            SELECT ficheiro, 'F' || k AS numero_fatura, duplicada, cadeia, nome AS loja, data_compra, total AS total_impresso, total_reconciliado, discrepancia, convencao, abs(discrepancia) >= 0.015::DOUBLE OR n_fora > 0 AS needs_review, n_fora, CASE WHEN duplicada THEN 0 ELSE n_itens END AS n_itens,
            i.descricao_original, i.produto, i.quantidade, valor AS preco_unitario, CASE convencao WHEN 'B' THEN valor - abs(desconto_direto) ELSE valor END AS preco_liquido, CASE WHEN unidade = 'un' THEN floor(CASE convencao WHEN 'B' THEN valor - abs(desconto_direto) ELSE valor END / quantidade * 10000 + 0.5::DOUBLE) / 10000 END AS preco_por_base, desconto_direto
            FROM envios JOIN loja ON loja.id = loja_id LEFT JOIN itens i ON i.fatura_id = k AND NOT duplicada""",
        "nomes_fatura": f"WITH {SKU_SQL}, {ITEM} SELECT fatura_id, descricao_original, coalesce(arg_max(nome_canonico, i.id) FILTER (nome_canonico != ''), descricao_original) AS produto FROM item i LEFT JOIN sku s ON s.id = i.sku_id GROUP BY 1, 2",
        "ultima_compra": f"{BASE} SELECT produto, CAST(preco_liquido AS DOUBLE) AS preco, preco_por_base, unidade_base, loja, cadeia, data, is_clearance FROM base WHERE {matches('widget')} AND {OK} ORDER BY {newest} LIMIT 1",
        "comparar_lojas": f"{BASE} SELECT cadeia, loja, preco_por_base, unidade_base, data FROM base WHERE {matches('red plate')} AND {PLAIN} QUALIFY row_number() OVER (PARTITION BY loja_id ORDER BY {newest}) = 1",
        "historico_preco": f"{BASE} SELECT data, cadeia, loja, preco_por_base, CAST(preco_liquido AS DOUBLE) AS preco_liquido, unidade_base FROM base WHERE {matches('brand#25')} AND {OK} AND NOT is_clearance AND data_compra >= DATE '1998-01-01'",
        "total_gasto": total_sql(f"{matches('ring')} AND cadeia = 'BUILDING'", "ring", "'BUILDING'"),
        "total_tudo": total_sql("TRUE", "tudo", "CAST(NULL AS VARCHAR)"),
        "listar_item": f"{BASE} SELECT data, cadeia, loja, produto, CAST(preco_liquido AS DOUBLE) AS preco_liquido FROM base WHERE {OK} AND {matches('bolt')} AND cadeia = 'MACHINERY' AND CAST(data_compra AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'",
        "listar_produto": f"{BASE} SELECT min(produto) AS produto, count(*) AS vezes, CAST(sum(preco_liquido) AS DOUBLE) AS total FROM base WHERE {OK} AND {PERIOD} GROUP BY lower(produto)",
        "mais_barato": f"{BASE} SELECT cadeia, loja, produto, preco_por_base, unidade_base, data FROM (SELECT * FROM base WHERE {matches('plate')} AND {PLAIN} QUALIFY row_number() OVER (PARTITION BY lower(produto) ORDER BY {newest}) = 1) ORDER BY preco_por_base, produto LIMIT 10",
        "detalhe_fatura": f"""WITH {LOJA}, {SKU_SQL}, {FATURA}, {ITEM}, uma AS (SELECT f.*, cadeia, nome AS loja FROM fatura f JOIN loja l ON l.id = f.loja_id WHERE cadeia = 'BUILDING' AND CAST(data_compra AS DATE) = DATE '1997-05-28' ORDER BY data_compra DESC, f.id DESC LIMIT 1)
            SELECT loja, cadeia, strftime(data_compra, '%Y-%m-%d') AS data, CAST(total_impresso AS DOUBLE) AS total, needs_review AS em_revisao, metodo_extracao, row_number() OVER (ORDER BY i.id) - 1 AS pos,
            coalesce(nome_canonico, descricao_original) AS produto, descricao_original, CAST(coalesce(preco_unitario, preco_liquido) AS DOUBLE) AS preco FROM uma JOIN item i ON i.fatura_id = uma.id LEFT JOIN sku s ON s.id = i.sku_id""",
        "habituais": habitual_sql(START, END),
        "habituais_60d": habitual_sql("2000-05-01", "2000-06-30"),
        "meses": "SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus != 'P' AND o_orderdate IS NOT NULL GROUP BY 1",
        "explorar_produtos": f"""{BASE} SELECT sku_id, any_value(nome_canonico) AS nome_canonico, any_value(nome_simplificado) AS nome_simplificado, any_value(categoria) AS categoria, any_value(unidade_base) AS unidade_base, count(DISTINCT fatura_id) AS n_compras,
            count(DISTINCT loja_id) AS n_lojas, round(min(preco_por_base), 4) AS preco_min, round(max(preco_por_base), 4) AS preco_max, CAST((array_agg(preco_liquido ORDER BY data_compra DESC, item_id DESC))[1] AS DOUBLE) AS ultimo_preco, CAST(sum(preco_liquido) AS DOUBLE) AS total_gasto, max(data) AS ultima
            FROM base WHERE {SHOWN} AND strftime(data_compra, '%Y-%m') = '1998-03' AND (nome_canonico LIKE '%pl%te%' OR coalesce(nome_simplificado LIKE '%pl%te%', FALSE)) GROUP BY sku_id ORDER BY n_compras DESC, max(data_compra) DESC, sku_id LIMIT 300""",
        "explorar_historico": f"""{BASE} SELECT data, cadeia AS loja, is_clearance AS promo, CAST(preco_liquido AS DOUBLE) AS pago, preco_por_base AS unitario, CAST(desconto_direto AS DOUBLE) AS desconto,
            round(CASE WHEN desconto_direto > 0.005 AND preco_liquido > 0 THEN preco_por_base * (CAST(preco_liquido AS DOUBLE) + CAST(desconto_direto AS DOUBLE)) / CAST(preco_liquido AS DOUBLE) ELSE preco_por_base END, 6) AS normal FROM base WHERE {SHOWN} AND sku_id = {SKU}""",
        "explorar_por_loja": f"{BASE} SELECT cadeia AS loja, count(*) AS n, round(avg(CAST(preco_liquido AS DOUBLE)), 2) AS media_paga, round(avg(preco_por_base), 4) AS media_unit FROM base WHERE {SHOWN} AND sku_id = {SKU} GROUP BY 1",
        "estatisticas_produto": f"""{BASE}, v AS (SELECT sku_id, cadeia, preco_por_base AS v, CAST(preco_liquido AS DOUBLE) AS pago, CAST(desconto_direto AS DOUBLE) AS d, struct_pack(x := data_compra, y := item_id) AS q FROM base WHERE {SHOWN}),
            e AS (SELECT sku_id, count(*) AS n, min(v) AS minimo, max(v) AS maximo, arg_min(v, q) AS primeiro, arg_max(v, q) AS ultimo, avg(v) AS media, sum(pago) AS total, sum(d) AS poupanca FROM v GROUP BY 1),
            l AS (SELECT sku_id, arg_min(cadeia, struct_pack(m := mv, c := cadeia)) AS mais_barata, min(mp) AS menor FROM (SELECT sku_id, cadeia, avg(v) AS mv, avg(pago) AS mp FROM v GROUP BY 1, 2) GROUP BY 1),
            t AS (SELECT *, CASE WHEN primeiro > 0 THEN (ultimo - primeiro) / primeiro * 100 ELSE 0 END AS tr, total - menor * n AS p FROM e JOIN l USING (sku_id)), r AS (SELECT *, CASE WHEN n < 2 THEN 'NOVO' WHEN tr >= 0 THEN 'A SUBIR' ELSE 'A DESCER' END AS veredicto FROM t)
            SELECT sku_id, n, minimo, maximo, primeiro, ultimo, round(media + {SHIFT}::DOUBLE, 5) AS media, round(total + {SHIFT}::DOUBLE, 5) AS total, round(poupanca + {SHIFT}::DOUBLE, 5) AS poupanca, mais_barata, round(tr + {SHIFT}::DOUBLE, 5) AS tendencia, round(p + {SHIFT}::DOUBLE, 5) AS pouparia, veredicto, veredicto = 'A SUBIR' AND p > 0.5 AS mostra_poupanca FROM r""",
        "sku_lista": f"""WITH {SKU_SQL}, {ITEM} SELECT s.id, nome_canonico, nome_simplificado, marca, categoria, unidade_base, formato_valor, count(i.id) AS n_itens, count(DISTINCT lower(i.descricao_original)) AS n_descricoes
            FROM sku s LEFT JOIN item i ON i.sku_id = s.id WHERE lower(nome_canonico) LIKE '%ring%' OR lower(marca) LIKE '%ring%' GROUP BY ALL ORDER BY n_itens DESC, nome_canonico, s.id LIMIT 500""",
        "sku_descricoes": f"WITH {ITEM} SELECT min(descricao_original) AS descricao_original, count(*) AS n, max(fatura_id) AS fatura_id FROM item WHERE sku_id = {SKU} GROUP BY {folded}",
        "descricoes_livres": f"WITH {SKU_SQL}, {ITEM} SELECT min(descricao_original) AS descricao_original, count(*) AS n, min(nome_canonico) AS sku_atual FROM item i LEFT JOIN sku s ON s.id = i.sku_id WHERE NOT is_non_product AND {folded} LIKE '%hot%' GROUP BY {folded} ORDER BY n DESC, 1 LIMIT 50",
        "faturas_lista": receipts_sql(""),
        "faturas_pendentes": receipts_sql("WHERE veredicto IS NULL"),
        "qualidade_cadeia": quality_sql("cadeia"),
        "qualidade_origem": quality_sql("origem_captura"),
        "qualidade_metodo": quality_sql("metodo_extracao"),
        "qualidade_modelo": f"""WITH {FATURA} SELECT coalesce(modelo, '—') AS modelo, metodo_extracao, count(*) AS n, count(*) FILTER (NOT needs_review) AS ok, round(100.0::DOUBLE * count(*) FILTER (NOT needs_review) / count(*), 1) AS pct_ok,
            round(avg(abs(CAST(discrepancia AS DOUBLE))), 3) AS disc_media FROM fatura GROUP BY fatura.modelo, metodo_extracao""",
        "outliers_preco": f"""{BASE}, linhas AS (SELECT b.* REPLACE (CASE WHEN i.quantidade = 1 THEN 0 ELSE b.preco_por_base END AS preco_por_base), CAST(i.quantidade AS DOUBLE) AS quantidade FROM base b JOIN item i ON i.id = b.item_id WHERE NOT b.is_non_product AND NOT b.is_clearance AND nome_canonico IS NOT NULL),
            pagas AS (SELECT * FROM linhas WHERE preco_por_base > 0), m AS (SELECT sku_id, median(preco_por_base) AS mediana FROM pagas GROUP BY 1 HAVING count(*) >= 2)
            SELECT sku_id, nome_canonico, unidade_base, fatura_id, descricao_original, quantidade, CAST(preco_liquido AS DOUBLE) AS preco_liquido, cadeia, data, preco_por_base, mediana, floor(preco_por_base / mediana * 10 + 0.5::DOUBLE) / 10 AS desvio
            FROM pagas JOIN m USING (sku_id) WHERE preco_por_base > mediana * 2 OR preco_por_base < mediana / 2""",
        "custos_total": "SELECT count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(12,8))), 6) AS DOUBLE) AS custo FROM events",
        "custos_contexto": "SELECT event_type AS contexto, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(12,8))), 6) AS DOUBLE) AS custo FROM events GROUP BY 1",
        "custos_modelo": "SELECT 'm' || (user_id % 4) AS modelo, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(12,8))), 6) AS DOUBLE) AS custo FROM events GROUP BY 1",
        "merge_identicos": f"""WITH {SKU_SQL}, {ITEM}, usos AS (SELECT s.id, lower(nome_canonico) AS nome, count(i.id) AS n FROM sku s LEFT JOIN item i ON i.sku_id = s.id GROUP BY ALL)
            SELECT id AS de, para FROM (SELECT id, first_value(id) OVER (PARTITION BY nome ORDER BY n DESC, id) AS para FROM usos) WHERE id != para""",
        "fuzzy_alvo": spelled_sql("widgt"),
        "procurar_nomes": spelled_sql("plte"),
        "procurar_linhas": f"{BASE} SELECT coalesce(sku_id, -1) AS sku_id, descricao_original, count(*) AS n, count(DISTINCT loja_id) AS n_lojas FROM base WHERE {matches('et 2')} GROUP BY ALL",
        "mediana_cadeia": f"{BASE} SELECT c AS cadeia, median(preco_por_base) AS mediana, count(*) AS n FROM (SELECT unnest(['*', cadeia]) AS c, preco_por_base FROM base WHERE preco_por_base > 0) GROUP BY 1",
        "expandir_alvo": total_sql(f"({drinks})", "bebida", "CAST(NULL AS VARCHAR)"),
        "formato": f"WITH {ITEM}, {PACKS} SELECT * FROM embalagens",
        "reconciliar": f"""{RECONCILED} SELECT f.*, abs(discrepancia) < 0.015 AS bate, pos, valor AS preco_unitario, CASE convencao WHEN 'B' THEN valor - abs(desconto_direto) ELSE valor END AS preco_liquido FROM feito f JOIN linhas USING (fatura_id)""",
        "preco_base": f"""WITH {SKU_SQL}, {ITEM}, {PACKS}, p AS (SELECT i.sku_id, CAST(preco_liquido AS DOUBLE) AS liq, CAST(quantidade AS DOUBLE) AS q, e.unidade_base AS u, e.formato_valor AS v, coalesce(s.unidade_base, e.unidade_base) AS alvo
            FROM item i JOIN embalagens e USING (descricao_original) LEFT JOIN sku s ON s.id = i.sku_id WHERE NOT is_non_product), d AS (SELECT sku_id, liq / CASE WHEN alvo != 'un' THEN CASE WHEN u = alvo AND v > 0 THEN v * q END WHEN u = 'un' AND v > 1 THEN v ELSE q END AS x FROM p)
            SELECT coalesce(s.sku_id, -1) AS sku_id, count(x) AS n, min(floor(x * 10000 + 0.5::DOUBLE) / 10000) AS menor, max(floor(x * 10000 + 0.5::DOUBLE) / 10000) AS maior FROM (SELECT DISTINCT sku_id FROM item) s LEFT JOIN d ON d.sku_id IS NOT DISTINCT FROM s.sku_id GROUP BY 1""",
        "sugestoes_merge": f"""WITH {SKU_SQL}, usos AS (SELECT s.*, (SELECT count(*) FROM lineitem WHERE l_partkey = s.id AND l_partkey % 17 != 0) AS n FROM sku s), nomes AS (SELECT DISTINCT unidade_base, nome_canonico, string_split(nome_canonico, ' ') AS t FROM sku),
            pares AS (SELECT a.unidade_base, a.nome_canonico AS na, b.nome_canonico AS nb, 2 * len(list_intersect(a.t, b.t)) / (len(list_distinct(a.t)) + len(list_distinct(b.t))) AS d, CASE WHEN len(a.t) <= len(b.t) THEN a.t ELSE b.t END AS x, CASE WHEN len(a.t) <= len(b.t) THEN b.t ELSE a.t END AS y
            FROM nomes a JOIN nomes b ON a.unidade_base = b.unidade_base), notas AS (SELECT unidade_base, na, nb, CASE WHEN list_has_all(y, x) AND len(list_distinct(x)) >= 2 AND x[1] = y[1] THEN greatest(d, 0.95::DOUBLE) ELSE d END AS s FROM pares)
            SELECT CASE WHEN a.n >= b.n THEN a.id ELSE b.id END AS manter, CASE WHEN a.n >= b.n THEN na ELSE nb END AS manter_nome, CASE WHEN a.n >= b.n THEN b.id ELSE a.id END AS fundir, CASE WHEN a.n >= b.n THEN nb ELSE na END AS fundir_nome, a.unidade_base, floor(s * 100 + 0.5::DOUBLE) / 100 AS score
            FROM notas p JOIN usos a ON a.nome_canonico = na AND a.unidade_base = p.unidade_base JOIN usos b ON b.nome_canonico = nb AND b.unidade_base = p.unidade_base AND a.id < b.id WHERE s >= 0.6::DOUBLE ORDER BY score DESC, manter, fundir LIMIT 100""",
        "diagnostico": f"""{RECONCILED}, w AS (SELECT fatura_id, count(*) AS n_linhas, min(pos) AS primeira FROM linhas WHERE quantidade >= 2 AND preco_unitario > 0 AND abs(quantidade * preco_unitario - abs(valor)) > 0.02 GROUP BY 1), {HINTS}
            SELECT fatura_id, discrepancia, tipo, linha, coalesce(n_linhas, 0) AS n_linhas, coalesce(primeira, -1) AS primeira FROM feito LEFT JOIN pistas USING (fatura_id) LEFT JOIN w USING (fatura_id) WHERE discrepancia != 0 OR n_linhas > 0""",
        "perfil": "SELECT turn AS id, text AS fato FROM conversations WHERE conv_id = 3 AND role = 'user' ORDER BY turn LIMIT 50",
        "seccoes": f"""{BASE}, c AS (SELECT *, CASE sku_id % 10 WHEN 0 THEN 'Frutas e Legumes' WHEN 1 THEN 'Padaria' WHEN 2 THEN 'Talho' WHEN 3 THEN 'Peixaria' WHEN 4 THEN 'Laticínios' WHEN 5 THEN 'Congelados' WHEN 6 THEN 'Bebidas' WHEN 7 THEN 'Ovos' WHEN 8 THEN 'Higiene' ELSE 'Outros' END AS seccao FROM base WHERE {SHOWN})
            SELECT seccao, count(DISTINCT sku_id) AS n, CAST(sum(preco_liquido) AS DOUBLE) AS total FROM c GROUP BY 1""",
        "palavras": f"""WITH n AS (SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS f, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
            SELECT doc_id, len(list_filter(string_split(t, ' '), lambda w: w != '' AND NOT list_contains({list(text.STOP_WORDS)}, w))) AS n_palavras, {section_sql('f')} AS seccao, length(t) AS n_letras FROM n""",
        "validar_linhas": f"WITH {LINES} SELECT fatura_id, pos, quantidade, preco_unitario, valor, quantidade * preco_unitario AS esperado FROM linhas WHERE quantidade >= 2 AND preco_unitario > 0 AND abs(quantidade * preco_unitario - abs(valor)) > 0.02",
        "pista": f"{RECONCILED}, {HINTS} SELECT fatura_id, tipo, linha, diferenca FROM pistas",
        # Each store's receipts one after another, with the numbers and totals that are kept so far.
        "dedup": f"""WITH RECURSIVE {FATURA}, t AS (SELECT id, loja_id, CASE WHEN id % 7 != 0 THEN 'F' || (id % 40) END AS numero, CASE WHEN id % 11 != 0 AND id % 13 != 0 THEN year(data_compra) || '/' || floor(total_impresso / 50000) END AS valor FROM fatura),
            ordem AS (SELECT *, row_number() OVER (PARTITION BY loja_id ORDER BY id % 2, id) AS k FROM t), passo AS (
            SELECT loja_id, 0::BIGINT AS k, 0::BIGINT AS id, FALSE AS fica, []::VARCHAR[] AS numeros, []::VARCHAR[] AS valores FROM ordem WHERE k = 1
            UNION ALL SELECT loja_id, k, id, fica, CASE WHEN fica AND numero IS NOT NULL THEN list_append(numeros, numero) ELSE numeros END, CASE WHEN fica AND valor IS NOT NULL THEN list_append(valores, valor) ELSE valores END FROM (
            SELECT o.*, p.numeros, p.valores, o.id % 2 = 0 OR NOT (coalesce(list_contains(p.numeros, o.numero), FALSE) OR coalesce(list_contains(p.valores, o.valor), FALSE)) AS fica FROM passo p JOIN ordem o ON o.loja_id = p.loja_id AND o.k = p.k + 1))
            SELECT id, p.loja_id, numero AS numero_fatura FROM passo p JOIN t USING (id) WHERE fica AND id % 2 = 1""",
        "orfaos": f"WITH {SKU_SQL} SELECT id, nome_canonico FROM sku WHERE id % 17 = 0 OR id NOT IN (SELECT l_partkey FROM lineitem)",
        "por_resolver": f"WITH {ITEM} SELECT min(descricao_original) AS descricao_original FROM item WHERE sku_id IS NULL AND NOT is_non_product GROUP BY {folded}",
        "chat_ultimas": "SELECT turn AS id, CAST(conv_id AS VARCHAR) AS utilizador, role AS papel, text AS conteudo FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
        "tipos_loja": """SELECT CASE c_custkey % 4 WHEN 0 THEN 'Continente' WHEN 1 THEN 'FARMÁCIA Central' ELSE c_mktsegment END AS cadeia, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 'supermercado' WHEN c_custkey % 4 = 1 THEN 'farmacia' ELSE 'outro' END AS tipo, count(*) AS n
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
        "habituais_por_dia": f"""{BASE}, viagens AS (SELECT lower(nome) AS chave, fatura_id, CAST(data_compra AS DATE) AS dia, min(nome) AS nome, max(categoria) AS categoria, count(*) AS n, sum(preco_liquido) AS pago, max(struct_pack(x := data_compra, y := item_id, z := preco_liquido)) AS ultimo
            FROM (SELECT *, coalesce(nome_simplificado, nome_canonico, descricao_original) AS nome FROM base WHERE {OK}) GROUP BY ALL), janelas AS (SELECT *, unnest(range(0, 61)) AS depois FROM viagens)
            SELECT hoje, produto, categoria, idas, meses, unidades, total, ultimo_preco FROM (SELECT strftime(dia + CAST(depois AS INTEGER), '%Y-%m-%d') AS hoje, chave, min(nome) AS produto, max(categoria) AS categoria, count(*) AS idas, count(DISTINCT strftime(dia, '%Y-%m')) AS meses, CAST(sum(n) AS BIGINT) AS unidades,
            CAST(sum(pago) AS DOUBLE) AS total, CAST(max(ultimo).z AS DOUBLE) AS ultimo_preco FROM janelas GROUP BY 1, 2 HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY hoje ORDER BY idas DESC, meses DESC, unidades DESC, produto, chave) <= 40""",
        "outliers_por_produto": f"""{BASE}, pagas AS (SELECT * FROM base WHERE NOT is_non_product AND NOT is_clearance AND nome_canonico IS NOT NULL AND preco_por_base > 0), m AS (SELECT sku_id, median(preco_por_base) AS md, count(*) AS n FROM pagas GROUP BY 1 HAVING count(*) >= 2),
            o AS (SELECT *, floor(preco_por_base / md * 10 + 0.5::DOUBLE) / 10 AS desvio FROM pagas JOIN m USING (sku_id) WHERE preco_por_base > md * 2 OR preco_por_base < md / 2)
            SELECT sku_id, nome_canonico, n, max(desvio) OVER (PARTITION BY sku_id) AS maior_desvio, row_number() OVER (PARTITION BY sku_id ORDER BY desvio DESC, item_id) - 1 AS lugar, fatura_id, preco_por_base, desvio FROM o""",
        "recolar_texto": f"WITH {ITEM} SELECT coalesce(CASE WHEN {folded} = (SELECT min({folded}) FROM item) THEN {SKU} ELSE sku_id END, -1) AS sku_id, count(*) AS n, count(DISTINCT descricao_original) AS textos FROM item GROUP BY 1",
        "dissociar_texto": f"""WITH {ITEM}, t AS (SELECT min(descricao_original) AS t FROM item WHERE sku_id = {SKU}), aliases AS (SELECT DISTINCT descricao_original, sku_id FROM item WHERE sku_id IS NOT NULL)
            SELECT 'item' AS tabela, CASE WHEN sku_id IS NULL OR sku_id = {SKU} AND descricao_original = t THEN -1 ELSE sku_id END AS sku_id, count(*) AS n FROM item, t GROUP BY 2 UNION ALL SELECT 'alias', sku_id, count(*) FROM aliases, t WHERE sku_id != {SKU} OR descricao_original != t GROUP BY 2""",
        "corrigir_quantidade": f"""WITH {ITEM}, x AS (SELECT *, id.a * 10 + id.b AS k FROM item), y AS (SELECT fatura_id, k = (SELECT min(k) FROM x) AS certa, quantidade, preco_liquido, preco_por_base FROM x)
            SELECT fatura_id, CAST(sum(CASE WHEN certa THEN 3 ELSE quantidade END) AS DOUBLE) AS quantidade, min(CASE WHEN certa THEN floor(CAST(preco_liquido AS DOUBLE) / 3 * 10000 + 0.5::DOUBLE) / 10000 ELSE preco_por_base END) AS menor, max(CASE WHEN certa THEN floor(CAST(preco_liquido AS DOUBLE) / 3 * 10000 + 0.5::DOUBLE) / 10000 ELSE preco_por_base END) AS maior FROM y GROUP BY 1""",
        "apagar_faturas": f"""WITH {SKU_SQL}, {FATURA}, {ITEM}, {VERDICTS}, f AS (SELECT * FROM fatura WHERE id % 50 = 0), i AS (SELECT * FROM item WHERE fatura_id NOT IN (SELECT id FROM fatura WHERE id % 50 != 0)), vivos AS (SELECT DISTINCT sku_id FROM i WHERE sku_id IS NOT NULL)
            SELECT 'fatura' AS tabela, loja_id AS chave, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'item', coalesce(sku_id, -1), count(*) FROM i GROUP BY 2 UNION ALL SELECT 'revisao', fatura_id, count(*) FROM revisao WHERE fatura_id % 50 = 0 GROUP BY 2
            UNION ALL SELECT 'sku_normalizado', id, 1 FROM sku WHERE id IN (SELECT sku_id FROM vivos) UNION ALL SELECT 'sku_alias', sku_id, count(DISTINCT descricao_original) FROM item WHERE sku_id IN (SELECT sku_id FROM vivos) GROUP BY 2""",
        "guardar_factos": """WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS utilizador, text AS fato, lower(strip_accents(trim(text))) AS k FROM conversations WHERE role = 'user'), g AS (SELECT arg_min(k, fato) AS k FROM f WHERE utilizador = '3'),
            r AS (SELECT utilizador, fato FROM f WHERE NOT (utilizador = '3' AND k = (SELECT k FROM g)) UNION ALL SELECT '3', 'Gosta de café') SELECT utilizador, count(*) AS n, min(fato) AS primeiro, max(fato) AS ultimo FROM r GROUP BY 1""",
        "rever_faturas": f"""{RECONCILED}, w AS (SELECT fatura_id, count(*) AS n_fora FROM linhas WHERE quantidade >= 2 AND preco_unitario > 0 AND abs(quantidade * preco_unitario - abs(valor)) > 0.02 GROUP BY 1)
            SELECT fatura_id, abs(discrepancia) >= 0.015 OR n_fora > 0 AS needs_review, coalesce(n_fora, 0) AS n_fora FROM (SELECT f.*, coalesce(w.n_fora, 0) AS n_fora FROM feito f LEFT JOIN w USING (fatura_id))""",
        "carrinho": f"""WITH c AS (SELECT DISTINCT p_name AS produto, {list(CATEGORIES)}[length(p_name) % {len(CATEGORIES)} + 1] AS categoria FROM part WHERE length(p_name) % 3 != 0)
            SELECT p_name AS produto, CAST(p_retailprice AS DOUBLE) AS preco, categoria, CASE WHEN contains(lower(categoria), 'pão') THEN 'Padaria' ELSE {section_sql("coalesce(lower(categoria), '')")} END AS seccao FROM part LEFT JOIN c ON p_name = produto""",
        "carrinho_total": "SELECT CAST(round(sum(CAST(p_retailprice AS DECIMAL(14,2))), 2) AS DOUBLE) AS total FROM part",
        "comparar_extracoes": """SELECT o_orderpriority AS metodo, count(*) AS n, count(*) FILTER (o_orderkey % 11 != 0 AND o_orderkey % 5 = 2) AS ok, CAST(sum(abs(o_orderkey % 5 - 2)) FILTER (o_orderkey % 11 != 0) AS DOUBLE) AS desvio, count(*) FILTER (o_orderkey % 11 = 0) AS erros FROM orders GROUP BY 1""",
        "abreviaturas": f"""WITH t AS (SELECT p_partkey AS id, {list(SHORT)}[p_partkey % {len(SHORT)} + 1] || ' ' || p_name || ' ' || {list(CHAINS)}[p_partkey % {len(CHAINS)} + 1] AS t FROM part)
            SELECT id, {written_out('t')} AS extenso, trim(regexp_replace(regexp_replace(t, '(?i)\\b({'|'.join(text.CHAIN_TOKENS)})\\b', '', 'g'), '\\s+', ' ', 'g')) AS sem_cadeia, nullif(upper(regexp_extract(t, '(?i)\\b({'|'.join(text.CHAIN_TOKENS)})\\b', 1)), '') AS cadeia_token FROM t""",
        "semaforo": f"""WITH q AS ({quality_sql('cadeia')}), p AS (SELECT grupo, floor(reconciliadas / n * 100 + 0.5::DOUBLE) AS a, floor(ok / nullif(revistas, 0) * 100 + 0.5::DOUBLE) AS b FROM q)
            SELECT grupo, CASE WHEN a >= 80 THEN 'good' WHEN a >= 50 THEN 'medium' ELSE 'bad' END AS leitura, CASE WHEN b >= 80 THEN 'good' WHEN b >= 50 THEN 'medium' ELSE 'bad' END AS revisao FROM p""",
        "pesquisa_explorador": f"""{BASE}, p AS (SELECT DISTINCT sku_id FROM base WHERE {SHOWN}), e AS (SELECT sku_id, any_value(nome_canonico) AS a, any_value(nome_simplificado) AS b, sum(preco_liquido) AS total FROM base WHERE {SHOWN} GROUP BY 1)
            SELECT q, count(sku_id) AS n, CAST(coalesce(sum(total), 0) AS DOUBLE) AS total FROM (VALUES ('pl%te'), ('plate')) AS t(q) LEFT JOIN e ON contains(lower(a), q) OR contains(lower(b), q) GROUP BY 1""",
    }
