"""Changes to the relations as functions from tables to tables; sources.tables.write_snapshot() makes a result durable.

Keys that the database compares without case and accents are compared by fold().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, normal_name, store_kind
from ..functions.units import half_up
from ..sources.extractions import lines as extracted_lines
from ..sources.extractions import parse
from ..sources.tables import complete, settled
from .receipts import fold_lines, needs_review, reconcile, reprice


def with_ids(new: DataFrame, existing: DataFrame, order: list[str], counted: str | None = None) -> DataFrame:
    """New rows with ids after the largest existing one, in a fixed order: ranges of it are numbered in tasks of their own.

    counted: a column of whole numbers; its sum over all rows before is added as `antes_<counted>`.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = settled(new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("lugar", F.monotonically_increasing_id()))
    part, place = F.shiftright("lugar", 33).alias("parte"), F.col("lugar").bitwiseAND(F.lit((1 << 33) - 1))  # the task, and the row's place in it
    sums = {"antes": F.count(F.lit(1)), **({"soma": F.sum(counted)} if counted else {})}
    sizes = rows.groupBy(part).agg(*(x.alias(n) for n, x in sums.items()))  # one row for each task
    until = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("parte", *(until(n, Window.partitionBy(F.lit(0)).orderBy("parte")).alias(n) for n in sums))
    numbered = rows.withColumn("parte", part)
    if counted:
        numbered = numbered.withColumn("nela", until(counted, Window.partitionBy("parte").orderBy("lugar")))
    numbered = numbered.join(F.broadcast(before), "parte").join(F.broadcast(top))
    if counted:
        numbered = numbered.withColumn(f"antes_{counted}", F.col("soma") + F.col("nela")).drop("soma", "nela")
    return numbered.withColumn("id", F.col("top") + F.col("antes") + place + 1).drop("top", "antes", "lugar", "parte")


def tidy_stores(incoming: DataFrame) -> DataFrame:
    """Stores with defaults (Desconhecida, the chain) and their kind; blank tax numbers are none."""
    chain = F.coalesce(F.nullif(F.trim("cadeia"), F.lit("")), F.lit("Desconhecida"))
    rows = incoming.withColumn("cadeia", chain).withColumn("nome", F.coalesce(F.nullif(F.trim("nome"), F.lit("")), F.col("cadeia")))
    return rows.withColumn("tipo", store_kind(F.col("cadeia"), F.col("nome"))).withColumn("nif", F.nullif(F.trim("nif"), F.lit("")))


def by_name() -> Column:
    return F.concat_ws("\u0000", F.lit("c"), fold(F.col("cadeia")), fold(F.col("nome")))


def by_number() -> Column:
    return F.concat(F.lit("n:"), F.col("nif"))


def new_stores(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Stores that are not there yet: by tax number if they have one, else by chain and name, which a store with a number may have too."""
    rows = tidy_stores(incoming).withColumn("__k", F.coalesce(by_number(), by_name()))
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__k").orderBy("cadeia", "nome"))).filter("__rn = 1").drop("__rn")
    known = existing.filter("nif is not null").select(by_number().alias("__k")).unionByName(existing.select(by_name().alias("__k")))
    known = known.unionByName(rows.filter("nif is not null").select(by_name().alias("__k")))  # of an upload, stores with a number come first
    return rows.join(known, "__k", "left_anti").drop("__k")


def upsert_stores(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All stores after an upload, and the incoming rows with `loja_id`: that of the store which is there already, of several the smallest, or the new one."""
    stores = existing.unionByName(with_ids(new_stores(incoming, existing), existing, ["cadeia", "nome", "nif"]), allowMissingColumns=True).select(*existing.columns)
    numbers = stores.filter("nif is not null").groupBy(by_number().alias("__k")).agg(F.min("id").alias("loja_id"))
    names = stores.groupBy(by_name().alias("__k")).agg(F.min("id").alias("loja_id"))
    found = tidy_stores(incoming).withColumn("__k", F.coalesce(by_number(), by_name())).join(numbers.unionByName(names), "__k", "left").drop("__k")
    return stores, found


def receipt_keys(receipts: DataFrame) -> DataFrame:
    """With kn, store and number, and kt, store, time and total: what duplicates share; null where a part of it is missing."""
    number = fold(F.nullif(F.trim(F.substring(F.trim("numero_fatura"), 1, 60)), F.lit("")))
    key = lambda *parts: F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\u0000"))))
    total = F.col("total_impresso").cast("decimal(18,4)")
    return receipts.select("*", key(F.lit("n"), F.col("loja_id"), number).alias("kn"), key(F.lit("t"), F.col("loja_id"), F.col("data_compra"), total).alias("kt"))


def new_receipts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Receipts that are no duplicates: of the same store, with an equal number, or an equal time and total, as one that is kept.

    They count as inserted in the order of their ids: what only a dropped receipt equals stays. A missing store, number, time
    or total equals none. Rows that equal no other are kept at once; the rest is decided in rounds, in each of which the first
    open row of its equals is kept and what equals it goes. Hot stores are no hot keys, since rows meet by number and total.
    """
    rows, old = receipt_keys(incoming), receipt_keys(existing)
    # A key that is missing stands for its row alone, so that such rows aren't gathered.
    rows = rows.withColumns({k: F.coalesce(F.col(k), F.concat(F.lit("row"), F.col("id").cast("string"))) for k in ("kn", "kt")})
    # Rows meet the kept ones and each other by a key in one shuffle. Those that go by the second key may count in the first.
    for key, n in (("kn", "n"), ("kt", "m")):
        rows = rows.join(old.filter(F.col(key).isNotNull()).select(key), key, "left_anti").withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(key)))
    same_number, same_total = Window.partitionBy("kn"), Window.partitionBy("kt")
    rows = settled(rows)
    single = rows.filter("n = 1 and m = 1").select(*incoming.columns)
    peers = rows.filter("n > 1 or m > 1").drop("n", "m")
    # Rows of one store that equal each other in both go with the first of them. Only ids and keys go through the rounds.
    open_ = peers.select("id", "kn", "kt").repartition("kn").withColumn("rn", F.row_number().over(Window.partitionBy("kn", "kt").orderBy("id"))).filter("rn = 1").drop("rn")
    open_, kept = settled(open_), None
    while not open_.isEmpty():
        judged = open_.withColumn("primeira", F.col("id") == F.min("id").over(same_number)).withColumn("fica", F.col("primeira") & (F.col("id") == F.min("id").over(same_total)))
        beaten = judged.withColumn("sai", F.max("fica").over(same_total)).withColumn("sai", F.col("sai") | F.max("fica").over(same_number))
        judged = settled(beaten.select("id", "kn", "kt", "fica", "sai"))
        won = judged.filter("fica").select("id")
        kept = won if kept is None else kept.unionByName(won)
        open_ = judged.filter("not sai").select("id", "kn", "kt")
    return single if kept is None else single.unionByName(peers.join(kept, "id", "left_semi").select(*incoming.columns))


def insert_receipts(receipts: DataFrame, items: DataFrame, incoming: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts and lines after an upload; the lines of duplicates stay out."""
    fresh = new_receipts(incoming, receipts)
    kept = lines.join(fresh.select(F.col("id").alias("fatura_id")), "fatura_id", "left_semi").select(*lines.columns)
    return receipts.unionByName(fresh, allowMissingColumns=True), items.unionByName(kept, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows whose key (folded where it is text) isn't there yet; of equal new ones the first in order."""
    text = {f.name for f in incoming.schema.fields if f.dataType.simpleString() == "string"}
    k = F.struct(*(fold(F.col(c)).alias(c) if c in text else F.col(c) for c in key))
    fresh = incoming.withColumn("k", k).withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*incoming.columns))).filter("rn = 1").drop("rn")
    return existing.unionByName(fresh.join(existing.select(k.alias("k")), "k", "left_anti").drop("k"), allowMissingColumns=True)


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming instead of those with their (folded) key; other keys are added."""
    kept = existing.withColumn("k", fold(F.col(key))).join(incoming.select(fold(F.col(key)).alias("k")), "k", "left_anti").drop("k")
    return kept.unionByName(incoming, allowMissingColumns=True)


def repoint(items: DataFrame, descricao: str, sku_id: int | None) -> DataFrame:
    """Gives all lines of a text another product, or none."""
    return items.withColumn("sku_id", F.when(fold(F.col("descricao_original")) == fold(F.lit(descricao)), F.lit(sku_id).cast("long")).otherwise(F.col("sku_id")))


def dissociate(items: DataFrame, aliases: DataFrame, sku_id: int, descricao: str) -> tuple[DataFrame, DataFrame]:
    same = (F.col("sku_id") == sku_id) & (fold(F.col("descricao_original")) == fold(F.lit(descricao)))
    return items.withColumn("sku_id", F.when(same, None).otherwise(F.col("sku_id"))), aliases.filter(~F.coalesce(same, F.lit(False)))


def merge(items: DataFrame, aliases: DataFrame, products: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products `de` become products `para` in lines and aliases, and go; aliases that move count as set by hand."""
    moved = mapping.filter("de != para").select(F.col("de").alias("sku_id"), "para")
    change = lambda rows: rows.join(moved, "sku_id", "left").withColumn("sku_id", F.coalesce("para", "sku_id"))
    known = change(aliases)
    if "origem" in aliases.columns:
        known = known.withColumn("origem", F.when(F.col("para").isNotNull(), "manual").otherwise(F.col("origem")))
    return change(items).select(*items.columns), known.select(*aliases.columns), products.join(moved.select(F.col("sku_id").alias("id")), "id", "left_anti").select(*products.columns)


def merge_two(items: DataFrame, aliases: DataFrame, products: DataFrame, de: int, para: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merge() of one product into another; a ValueError for equal or missing ids, a LookupError if there is no such product."""
    if not de or not para or de == para:
        raise ValueError("de and para must be ids of two products")
    if products.filter(F.col("id").isin(de, para)).select("id").distinct().count() < 2:
        raise LookupError("no such product")
    return merge(items, aliases, products, products.sparkSession.createDataFrame([(de, para)], "de long, para long"))


def identical_names(products: DataFrame, items: DataFrame, strict: bool = False, names: DataFrame | None = None) -> DataFrame:
    """de, para: products whose names have the same letters and digits; the most used one stays, the smallest id on a tie.

    strict: of one brand and unit, too; names: only products of these names (nome_canonico), such as those of one receipt.
    """
    used = items.filter("sku_id is not null").groupBy(F.col("sku_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    key = normal_name(F.col("nome_canonico"))
    rows = products.withColumn("chave", key).filter("chave != ''")
    if names is not None:
        rows = rows.join(names.select(key.alias("chave")).distinct(), "chave", "left_semi")
    rows = rows.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    group = ["chave", *(["marca", "unidade_base"] if strict else [])]
    best = rows.groupBy(*group).agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("para"))
    joined = rows.alias("r").join(best.alias("b"), [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group])
    return joined.filter("r.id != b.para").select(F.col("r.id").alias("de"), F.col("b.para").alias("para"))


def edit(rows: DataFrame, id_: int, **values: Column | str | float | None) -> DataFrame:
    """Sets columns of the row with the id."""
    own = F.col("id") == id_
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.when(own, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def edit_product(products: DataFrame, items: DataFrame, id_: int, **values: str | None) -> tuple[DataFrame, DataFrame]:
    """Sets a product's columns; a new unit (kg, L or un, others are no change) prices all its lines anew, whatever it was before."""
    if values.get("unidade_base") not in ("kg", "L", "un"):
        values.pop("unidade_base", None)
    if "nome_canonico" in values and not (values["nome_canonico"] or "").strip():
        raise ValueError("a product needs a name")
    products = edit(products, id_, **values)
    if "unidade_base" in values:
        own = F.col("sku_id").eqNullSafe(F.lit(id_))
        items = items.filter(~own).unionByName(reprice(items.filter(own), products))
    return products, items


def edit_quantity(items: DataFrame, id_: int, quantity: float) -> DataFrame:
    """Sets a line's quantity, and its price per unit from it."""
    if not quantity > 0:
        raise ValueError("a quantity must be above 0")
    return edit(items, id_, quantidade=quantity, preco_por_base=half_up(F.col("preco_liquido").cast("double") / quantity, 4))


def delete_receipts(receipts: DataFrame, items: DataFrame, reviews: DataFrame, products: DataFrame, aliases: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Without the receipts `gone` (id): their lines and reviews go, then products without any line, then those products' aliases."""
    keys = gone.select(F.col("id").alias("fatura_id"))
    left_items = items.join(keys, "fatura_id", "left_anti").select(*items.columns)
    left_products = products.join(left_items.select(F.col("sku_id").alias("id")), "id", "left_semi").select(*products.columns)
    return {
        "fatura": receipts.join(gone.select("id"), "id", "left_anti").select(*receipts.columns),
        "item": left_items,
        "revisao": reviews.join(keys, "fatura_id", "left_anti").select(*reviews.columns),
        "sku_normalizado": left_products,
        "sku_alias": aliases.join(left_products.select(F.col("id").alias("sku_id")), "sku_id", "left_semi").select(*aliases.columns),
    }


def replace_items(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lines after receipts were processed again: all lines of the receipts in `fresh` give way to it."""
    kept = items.join(fresh.select("fatura_id").distinct(), "fatura_id", "left_anti").select(*items.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def remember(facts: DataFrame, utilizador: str, fato: str) -> DataFrame:
    spark = facts.sparkSession
    new = spark.createDataFrame([(utilizador, fato.strip()[:300])], "utilizador string, fato string")
    return insert_ignore(facts, new, ["utilizador", "fato"])


def item_rows(lines: DataFrame, priced: DataFrame) -> DataFrame:
    """Folded lines (fatura_id, pos, ...) as they are stored, with their prices (fatura_id, pos, unitario, preco_liquido)."""
    return stored_lines(lines.join(priced, ["fatura_id", "pos"]))


def stored_lines(rows: DataFrame, *more: str) -> DataFrame:
    """Folded lines with their prices (fatura_id, pos, unitario, preco_liquido, ...) as they are stored: texts cut, defaults set, no product yet; and the columns `more`."""
    quantity = F.coalesce(F.nullif("quantidade", F.lit(0.0)), F.lit(1.0)).alias("quantidade")
    off = F.coalesce(F.col("desconto_direto"), F.lit(0.0)).alias("desconto_direto")
    flags = (F.coalesce(c, F.lit(False)).alias(c) for c in ("is_clearance", "is_non_product"))
    texts = F.substring(F.coalesce("descricao_original", F.lit("")), 1, 200).alias("descricao_original"), F.nullif(F.substring("linha_peso", 1, 80), F.lit("")).alias("linha_peso")
    return rows.select("fatura_id", "pos", F.lit(None).cast("long").alias("sku_id"), *texts, quantity, F.col("unitario").alias("preco_unitario"), "preco_liquido", F.lit(None).cast("double").alias("preco_por_base"), off, *flags, *more)


def reprocess(receipts: DataFrame, items: DataFrame, again: DataFrame, aliases: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts and lines after some receipts were read again: again has their id and the new extracao_json.

    Lines are folded, reconciled, priced and given the product that their text is known for, and take the place of the old
    ones; of the receipt the totals, the discrepancy, the need for review and the snapshot change, while store, number,
    time and model stay. No duplicates are looked for. A receipt whose new extraction can't be read stays as it is.
    """
    read = parse(again.select(F.col("id").alias("fatura_id"), "extracao_json")).filter("extracao is not null")
    lines = fold_lines(extracted_lines(read, "fatura_id"), "fatura_id")
    done = reconcile(lines, read.select("fatura_id", "extracao.total_impresso", "extracao.desconto_global", "extracao.iva"), "fatura_id")
    priced = done.select("fatura_id", F.explode("itens").alias("i")).select("fatura_id", "i.pos", "i.preco_liquido", F.col("i.preco_unitario").alias("unitario"))
    known = aliases.groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min("sku_id").alias("sku_id"))
    rows = item_rows(lines, priced).withColumn("chave", fold(F.col("descricao_original"))).drop("sku_id").join(known, "chave", "left").drop("chave")
    rows = reprice(with_ids(rows, items, ["fatura_id", "pos"]), products)
    fresh = complete(rows, "item")
    facts = done.join(needs_review(done, lines, "fatura_id").select("fatura_id", F.col("needs_review").alias("rever")), "fatura_id").join(read.select("fatura_id", "extracao_json", "extracao.total_impresso", F.coalesce("extracao.desconto_global", F.lit(0.0)).alias("desconto_global")), "fatura_id")
    new = facts.select(F.col("fatura_id").alias("id"), F.struct("total_impresso", "total_reconciliado", "discrepancia", F.col("rever").alias("needs_review"), "desconto_global", "extracao_json").alias("novo"))
    kinds = dict(receipts.dtypes)
    changed = {c: F.when(F.col("novo").isNotNull(), F.col(f"novo.{c}").cast(kinds[c])).otherwise(F.col(c)) for c in ("total_impresso", "total_reconciliado", "discrepancia", "needs_review", "desconto_global", "extracao_json") if c in kinds}
    return receipts.join(new, "id", "left").withColumns(changed).select(*receipts.columns), replace_items(items, fresh.select(*items.columns))


def append(rows: DataFrame, ddl: str, values: tuple) -> DataFrame:
    """One row more, with the next id."""
    new = rows.sparkSession.createDataFrame([values], ddl)
    return rows.unionByName(with_ids(new, rows, [new.columns[0]]), allowMissingColumns=True)


def append_message(messages: DataFrame, utilizador: str, papel: str, conteudo: str | None) -> DataFrame:
    return append(messages, "utilizador string, papel string, conteudo string", (utilizador, papel, str(conteudo or "")[:4000]))


def append_review(reviews: DataFrame, fatura_id: int, veredicto: str, comentario: str | None = None, operador: str | None = None) -> DataFrame:
    if veredicto not in ("ok", "erro"):
        raise ValueError("veredicto must be ok or erro")
    return append(reviews, "fatura_id long, veredicto string, comentario string, operador string", (fatura_id, veredicto, comentario and comentario[:2000], operador))


def append_cost(calls: DataFrame, contexto: str | None, modelo: str | None, usage: dict | None) -> DataFrame:
    """A model call's tokens and cost; nothing without `usage` (prompt_tokens, completion_tokens, cost)."""
    if not usage:
        return calls
    values = (str(contexto or "geral")[:30], str(modelo or "")[:60], int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0), str(usage.get("cost") or 0))
    row = append(calls.limit(0).withColumn("custo", F.col("custo").cast("string")), "contexto string, modelo string, prompt_tokens int, completion_tokens int, custo string", values)
    numbered = with_ids(row, calls, ["contexto"])
    return calls.unionByName(numbered.withColumn("custo", F.col("custo").cast(dict(calls.dtypes)["custo"])), allowMissingColumns=True)


def forget(facts: DataFrame, utilizador: str, fato: str) -> DataFrame:
    return facts.filter(~((F.col("utilizador") == utilizador) & (fold(F.col("fato")) == fold(F.lit(fato)))))


def classify_stores(stores: DataFrame) -> DataFrame:
    return stores.withColumn("tipo", store_kind(F.col("cadeia"), F.col("nome")))
