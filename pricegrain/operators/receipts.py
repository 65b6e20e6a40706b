"""Receipts from extracted lines to rows: folding, reconciliation, line checks, hints, corrections, prices.

Lines are exploded rows (receipt key, pos, ...); what needs a receipt's lines in order uses windows or arrays sorted by
position, so sums run in the order of the receipt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import half_up, pack_format, price_per_base
from ..sources.extractions import readable_only
from ..sources.tables import settled

# What discount and weight lines of receipts look like.
DISCOUNT = r"(?iu)^(?:poupan|desconto|desc\.|promo[çc])"
WEIGHT = r"\d+[.,]\d+\s*kg\s*[x×]?\s*\d+[.,]\d+\s*(?:eur|€)\s*/\s*kg"
BARE_WEIGHT = r"\d+,\d{2,3}\s*[x×]\s*\d+,\d{1,2}"
LOOSE = rf"(?iu)^\s*{WEIGHT}"
INLINE = rf"(?iu)\s+({WEIGHT}|{BARE_WEIGHT})\s*$"


def discounts(text: Column) -> Column:
    """Whether a text is that of a discount line; the pattern is tried only where its first letter is there."""
    return F.substring(text, 1, 1).isin("p", "P", "d", "D") & text.rlike(DISCOUNT)


def has_fraction(text: Column) -> Column:
    """Without a comma or a point a text holds no weight, so its patterns aren't tried."""
    return text.contains(",") | text.contains(".")


def fold_lines(lines: DataFrame, key: str) -> DataFrame:
    """Discount lines go into the line above as its discount, weight lines as its weight and value; weights leave names.

    lines: key, pos, descricao_original, valor, desconto_direto, ... A discount or weight line without a line above stays.
    Other columns are those of the line itself.
    """
    text = F.trim(F.coalesce("descricao_original", F.lit("")))
    order = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("descricao_original", text).withColumn("vazio", F.row_number().over(order) == 1)
    kind = F.when(F.col("vazio"), "linha").when(text.rlike(DISCOUNT), "desconto").when(text.rlike(LOOSE), "peso").otherwise("linha")
    rows = rows.withColumn("especie", kind).withColumn("grupo", F.sum((F.col("especie") == "linha").cast("int")).over(order))
    # Attached lines of a receipt may differ in kind; each kind is gathered over the group of the line above.
    amount = F.when(F.col("especie") == "desconto", F.abs(F.coalesce("valor", "desconto_direto", F.lit(0.0))))
    attached = rows.filter("especie != 'linha'").groupBy(key, "grupo").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(amount, F.lit(0.0)).alias("x")))), F.lit(0.0), lambda a, e: a + e["x"]).alias("descontos"),
        F.max_by("descricao_original", F.when(F.col("especie") == "peso", F.col("pos"))).alias("peso"),
        F.max_by("valor", F.when((F.col("especie") == "peso") & F.col("valor").isNotNull(), F.col("pos"))).alias("valor_do_peso"),
        F.count_if(F.col("especie") == "desconto").alias("n_descontos"),
    )
    heads = rows.filter("especie = 'linha'").join(attached, [key, "grupo"], "left")
    name = F.col("descricao_original")
    own = F.nullif(F.regexp_extract(name, INLINE, 1), F.lit(""))
    clean = F.when(own.isNotNull(), F.trim(F.regexp_replace(name, INLINE, ""))).otherwise(name)
    discount = F.when(F.coalesce("n_descontos", F.lit(0)) > 0, F.coalesce("desconto_direto", F.lit(0.0)) + F.col("descontos")).otherwise(F.col("desconto_direto"))
    out = heads.withColumns({"descricao_original": clean, "linha_peso": F.coalesce("peso", own), "valor": F.coalesce("valor_do_peso", "valor"), "desconto_direto": discount})
    return out.drop("vazio", "especie", "grupo", "descontos", "peso", "valor_do_peso", "n_descontos")


def reconcile(lines: DataFrame, totals: DataFrame, key: str, empty: bool = False) -> DataFrame:
    """One row per receipt: subtotal, convencao, total_reconciliado, discrepancia, bate, and its priced lines as an array `itens`.

    totals: key, total_impresso, desconto_global, iva. Line values are net (A), or gross with real line discounts (B);
    whichever comes closer to the printed total without VAT holds, A on a tie. Without a total nothing is discrepant.
    empty: receipts without lines count too, with sums of 0.
    """
    value = F.coalesce(F.col("valor").cast("double"), F.lit(0.0)).alias("valor")
    off = F.abs(F.coalesce(F.col("desconto_direto").cast("double"), F.lit(0.0))).alias("desconto_direto")
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", value, off))).alias("linhas"))  # the lines of one receipt
    rows = listed.join(totals, key, "right" if empty else "inner")
    if empty:
        rows = rows.withColumn("linhas", F.coalesce("linhas", F.array().cast(rows.schema["linhas"].dataType)))
    return reconciled(rows).select(key, "subtotal", "convencao", "total_reconciliado", "discrepancia", "bate", "itens")


def reconciled(rows: DataFrame) -> DataFrame:
    """Rows of receipts (linhas, total_impresso, desconto_global, iva) with what reconcile() adds; linhas (pos, valor, desconto_direto, ...) are in order."""
    amount = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    rows = rows.withColumn("__l", F.transform("linhas", lambda x: F.struct(x["pos"].alias("pos"), amount(x["valor"]).alias("valor"), F.abs(amount(x["desconto_direto"])).alias("desconto_direto"))))
    sum_of = lambda get: F.aggregate("__l", F.lit(0.0), lambda a, x: a + get(x))
    net = lambda x: x["valor"] - x["desconto_direto"]
    total, card, vat = F.col("total_impresso").cast("double"), F.coalesce(F.col("desconto_global").cast("double"), F.lit(0.0)), F.coalesce(F.col("iva").cast("double"), F.lit(0.0))
    rows = rows.withColumns({"subtotal": sum_of(lambda x: x["valor"]), "__descontos": sum_of(lambda x: x["desconto_direto"]), "__liquido": sum_of(net)})
    gross = F.col("subtotal")
    a, b = gross - card, gross - F.col("__descontos") - card
    goal = F.coalesce(total - vat, b)
    rows = rows.withColumn("convencao", F.when(F.abs(b - goal) < F.abs(a - goal), "B").otherwise("A"))
    real = F.col("convencao") == "B"
    base = F.when(real, F.col("__liquido")).otherwise(gross)
    priced = F.transform("__l", lambda x: F.struct(x["pos"].alias("pos"), x["valor"].alias("preco_unitario"), half_up(F.when(real, net(x)).otherwise(x["valor"]), 2).alias("preco_liquido")))
    gap = F.coalesce(half_up(base - card + vat - total, 2), F.lit(0.0))
    rows = rows.withColumns({"total_reconciliado": half_up(base - card + vat, 2), "discrepancia": gap, "itens": priced})
    return rows.withColumn("bate", F.abs("discrepancia") < 0.015).drop("__l", "__descontos", "__liquido")


def wrong_lines(lines: DataFrame) -> DataFrame:
    """Lines of two or more whose quantity times unit price is not their value."""
    q = F.coalesce(F.nullif(F.col("quantidade").cast("double"), F.lit(0.0)), F.lit(1.0))
    u, v = F.col("preco_unitario").cast("double"), F.abs(F.coalesce(F.col("valor").cast("double"), F.lit(0.0)))
    rows = lines.withColumn("esperado", half_up(q * u, 2))
    return rows.filter((q >= 2) & (u > 0) & (F.abs(F.col("esperado") - v) > 0.02))


def hint(lines: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """key, tipo, linha, diferenca: the first line whose value, else whose discount, equals the gap; else its direction; no row without a gap.

    tipo: DUPLICADO or FALTAR for a value, DESCONTO for a line discount, ACIMA or ABAIXO for the direction alone.
    """
    gap = half_up(F.coalesce(F.col("discrepancia").cast("double"), F.lit(0.0)), 2)
    rows = lines.join(gaps.select(key, gap.alias("gap")).filter("gap != 0"), key, "right")
    near = lambda c: F.abs(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) - F.abs("gap")) <= 0.02
    name = F.substring(F.trim(F.coalesce("descricao_original", F.lit(""))), 1, 40)
    by_value, by_discount = near("valor") & F.col("pos").isNotNull(), near("desconto_direto") & (F.col("desconto_direto") != 0)
    found = rows.groupBy(key, "gap").agg(F.min_by(name, F.when(by_value, F.col("pos"))).alias("por_valor"), F.min_by(name, F.when(by_discount, F.col("pos"))).alias("por_desconto"))
    kind = F.when(F.col("por_valor").isNotNull(), F.when(F.col("gap") > 0, "DUPLICADO").otherwise("FALTAR")).when(F.col("por_desconto").isNotNull(), "DESCONTO").when(F.col("gap") > 0, "ACIMA").otherwise("ABAIXO")
    return found.select(key, kind.alias("tipo"), F.coalesce("por_valor", "por_desconto").alias("linha"), F.abs("gap").alias("diferenca"))


def folded(rows: DataFrame) -> DataFrame:
    """Rows of receipts with `linhas` from `itens` (the extracted lines as an array): pos, and the lines as fold_lines() makes them.

    Nothing leaves its row, so the lines of a receipt aren't shuffled to meet each other again.
    """
    text = lambda x: F.trim(F.coalesce(x["descricao_original"], F.lit("")))
    fields = ("valor", "desconto_direto", "quantidade", "preco_unitario", "is_clearance", "is_non_product")
    kind = lambda x, i: F.when(i == 0, "linha").when(discounts(text(x)), "desconto").when(has_fraction(text(x)) & text(x).rlike(LOOSE), "peso").otherwise("linha")
    rows = rows.withColumn("__l", F.transform("itens", lambda x, i: F.struct(i.alias("pos"), kind(x, i).alias("especie"), text(x).alias("nome"), *(x[f].alias(f) for f in fields))))
    # Only receipts with attached lines need more than a look at each line.
    rows = rows.withColumn("__h", F.when(F.exists("__l", lambda x: x["especie"] != "linha"), F.filter("__l", lambda x: x["especie"] == "linha")))
    # The lines from one head to the next are attached to it.
    after = lambda j: F.coalesce(F.get("__h", j + 1)["pos"], F.size("__l"))
    rows = rows.withColumn("__h", F.transform("__h", lambda h, j: F.struct(h.alias("h"), F.slice("__l", h["pos"] + 2, after(j) - h["pos"] - 1).alias("presas"))))

    def own_weight(name: Column) -> Column:
        return F.when(has_fraction(name), F.nullif(F.regexp_extract(name, INLINE, 1), F.lit("")))

    def line(h: Column, own: Column, weight: Column, value: Column, off: Column) -> Column:
        clean = F.when(own.isNotNull(), F.trim(F.regexp_replace(h["nome"], INLINE, ""))).otherwise(h["nome"])
        named = {"pos": h["pos"], "descricao_original": clean, "linha_peso": F.coalesce(weight, own), "valor": value, "desconto_direto": off}
        return F.struct(*(c.alias(n) for n, c in named.items()), *(h[f].alias(f) for f in fields[2:]))

    def told(x: Column) -> Column:
        off = F.filter(x["presas"], lambda y: y["especie"] == "desconto")
        weight = F.filter(x["presas"], lambda y: y["especie"] == "peso")
        return F.struct(x["h"].alias("h"), own_weight(x["h"]["nome"]).alias("peso_no_nome"), off.alias("descontos"), weight.alias("pesos"))

    def whole(x: Column) -> Column:
        h, last = x["h"], lambda rows_: F.try_element_at(rows_, F.lit(-1))
        value = last(F.filter(x["pesos"], lambda y: y["valor"].isNotNull()))["valor"]
        taken = F.aggregate(x["descontos"], F.lit(0.0), lambda a, y: a + F.abs(F.coalesce(y["valor"], y["desconto_direto"], F.lit(0.0))))
        off = F.when(F.size(x["descontos"]) > 0, F.coalesce(h["desconto_direto"], F.lit(0.0)) + taken).otherwise(h["desconto_direto"])
        return line(h, x["peso_no_nome"], last(x["pesos"])["nome"], F.coalesce(value, h["valor"]), off)

    alone = F.transform("__l", lambda x: line(x, own_weight(x["nome"]), F.lit(None).cast("string"), x["valor"], x["desconto_direto"]))
    attached = F.transform(F.transform("__h", told), whole)
    return rows.withColumn("linhas", F.when(F.col("__h").isNull(), alone).otherwise(attached)).drop("__l", "__h")


def checked(rows: DataFrame) -> DataFrame:
    """Rows of receipts (linhas, discrepancia) with `erradas`, what wrong_lines() finds in linhas (pos, descricao_original, ...), and `pista`, what hint() says, or null."""
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    many = lambda x: F.coalesce(F.nullif(x["quantidade"].cast("double"), F.lit(0.0)), F.lit(1.0))
    due = lambda x: half_up(many(x) * x["preco_unitario"].cast("double"), 2)
    line = lambda x: F.struct(*(x[c].alias(c) for c in ("pos", "descricao_original", "quantidade", "preco_unitario", "valor")), due(x).alias("esperado"))
    wrong = lambda x: (many(x) >= 2) & (x["preco_unitario"].cast("double") > 0) & (F.abs(x["esperado"] - F.abs(number(x["valor"]))) > 0.02)
    gap = half_up(number(F.col("discrepancia")), 2)
    rows = rows.withColumns({"erradas": F.filter(F.transform("linhas", line), wrong), "__gap": gap})
    near = lambda x: F.abs(F.abs(number(x)) - F.abs("__gap")) <= 0.02
    name = lambda x: F.substring(F.trim(F.coalesce(x["descricao_original"], F.lit(""))), 1, 40)
    first = lambda condition: F.get(F.transform(F.filter("linhas", condition), name), F.lit(0))
    odd = F.col("__gap") != 0
    rows = rows.withColumns({"__v": F.when(odd, first(lambda x: near(x["valor"]))), "__d": F.when(odd, first(lambda x: near(x["desconto_direto"]) & (x["desconto_direto"] != 0)))})
    kind = F.when(F.col("__v").isNotNull(), F.when(F.col("__gap") > 0, "DUPLICADO").otherwise("FALTAR")).when(F.col("__d").isNotNull(), "DESCONTO").when(F.col("__gap") > 0, "ACIMA").otherwise("ABAIXO")
    told = F.struct(kind.alias("tipo"), F.coalesce("__v", "__d").alias("linha"), F.abs("__gap").alias("diferenca"))
    return rows.withColumn("pista", F.when(odd, told)).drop("__gap", "__v", "__d")


def needs_review(reconciled: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, needs_review: the total doesn't match, or a line doesn't."""
    bad = wrong_lines(lines).groupBy(key).agg(F.count(F.lit(1)).alias("n_fora"))
    return reconciled.join(bad, key, "left").select(key, (~F.col("bate") | (F.coalesce("n_fora", F.lit(0)) > 0)).alias("needs_review"), F.coalesce("n_fora", F.lit(0).cast("long")).alias("n_fora"))


def best_extraction(candidates: DataFrame, key: str) -> DataFrame:
    """Of several extractions of a receipt (key, tentativa, discrepancia, n_fora, ...) the one that is off least, the earliest on a tie."""
    badness = F.struct(F.abs("discrepancia") + F.col("n_fora"), "tentativa")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(badness))
    return candidates.withColumn("rn", rank).filter("rn = 1").drop("rn")


def corrected(first: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: str, most: int = 2) -> DataFrame:
    """Asks the injected step for up to `most` new extractions of receipts (key, total_impresso, discrepancia, n_fora, ...) that are still off.

    The open receipts are a frontier: one stays in it while each try is strictly better than the last and still off, and
    leaves it when it adds up, when a try is no better or is missing (the step failed), or without a printed total, of which
    nothing is known. A try that is no better is dropped. Rounds cost what the frontier holds, and end when it is empty.
    step: the open receipts and the number of the try; it returns their columns, one row for each receipt it could read.
    `tentativa` is the try that each receipt's row comes from.
    """
    off = (F.abs("discrepancia") >= 0.015) | (F.col("n_fora") > 0)
    asks = F.coalesce(off & F.col("total_impresso").isNotNull(), F.lit(False))
    badness = F.abs("discrepancia") + F.col("n_fora")
    rows = settled(first.withColumn("tentativa", F.lit(0)))
    done, open_ = rows.filter(~asks), rows.filter(asks)
    for number in range(1, most + 1):
        if open_.isEmpty():
            break
        tries = step(open_.drop("tentativa"), number).withColumn("tentativa", F.lit(number))
        new = tries.select(key, F.struct(*rows.columns).alias("nova"), badness.alias("falta_nova"))
        old = open_.select(key, F.struct(*rows.columns).alias("velha"), badness.alias("falta"))
        better = F.coalesce(F.col("falta_nova") < F.col("falta"), F.lit(False))
        chosen = old.join(new, key, "left").select(F.when(better, F.col("nova")).otherwise(F.col("velha")).alias("r"), better.alias("melhor"))
        chosen = settled(chosen.select("r.*", "melhor"))
        goes_on = F.col("melhor") & asks
        done, open_ = done.unionByName(chosen.filter(~goes_on).drop("melhor")), chosen.filter(goes_on).drop("melhor")
    return done.unionByName(open_)


def priced(lines: DataFrame, target: Column | None = None) -> DataFrame:
    """Adds preco_por_base, from the name and weight of a line; null for what is no product."""
    pack = pack_format(F.trim(F.concat_ws(" ", "descricao_original", "linha_peso")))
    # The pack is bound to a variable: its patterns are matched once, and not written out for each of its fields.
    price = F.get(F.transform(F.array(pack), lambda p: price_per_base(F.col("preco_liquido"), F.col("quantidade"), p, target)), F.lit(0))
    return lines.withColumn("preco_por_base", F.when(F.coalesce("is_non_product", F.lit(False)), None).otherwise(price))


def reprice(items: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with the price per their product's unit, where they have a product."""
    unit = products.select(F.col("id").alias("sku_id"), F.col("unidade_base").alias("unidade_do_sku"))
    return priced_in(items.join(unit, "sku_id", "left"), "unidade_do_sku").select(*items.columns)


def priced_in(items: DataFrame, unit: str) -> DataFrame:
    """Lines with the price per the unit in the column `unit`, without that column."""
    return priced(items, F.col(unit)).select(*(c for c in items.columns if c != unit))


def purchase_time(text: Column) -> Column:
    """An ISO time as a timestamp without zone, to the second; a day alone is its midnight, what is neither is null."""
    return F.try_to_timestamp(F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)).cast("timestamp_ntz")


def named_lines(lines: DataFrame, items: DataFrame, products: DataFrame, key: str = "fatura_id") -> DataFrame:
    """Lines of uploads (key, descricao_original, ...) with `produto`: the canonical name that their text was given on that receipt, else the text.

    Where lines of one text have different products, the last line's name holds for all of them; texts are compared as they are.
    """
    product = products.filter("nome_canonico != ''").select(F.col("id").alias("sku_id"), "nome_canonico")
    names = items.join(product, "sku_id").groupBy(key, "descricao_original").agg(F.max_by("nome_canonico", "id").alias("canonico"))
    return lines.join(names, [key, "descricao_original"], "left").withColumn("produto", F.coalesce("canonico", "descricao_original")).drop("canonico")


def upload_note(chain: Column, name: Column, bought: Column, total: Column, n_lines: Column, fits: Column) -> Column:
    """What the chat keeps of an upload: store, day, total and number of lines, and whether it is under review."""
    amount = F.replace(F.format_string("%.2f", total.cast("double")), F.lit("."), F.lit(","))
    review = F.when(F.coalesce(fits, F.lit(False)), "").otherwise(" (em revisão — diferença a confirmar)")
    shop = F.coalesce(F.nullif(chain, F.lit("")), name, F.lit(""))
    return F.concat(F.lit("📄 "), shop, F.lit(", "), F.substring(F.coalesce(bought, F.lit("")), 1, 10), F.lit(", total "), amount, F.lit(" €, "), n_lines.cast("string"), F.lit(" itens."), review)


def diagnosis(receipts: DataFrame, key: str = "id") -> DataFrame:
    """key, discrepancia, iva, pista, linhas_inconsistentes of stored receipts (extracao_json, discrepancia, needs_review).

    The hint and the lines that don't add up are computed from the snapshot of the extraction. Receipts with neither are
    left out unless they are under review, and so are those without a snapshot that can be read.
    """
    rows = readable_only(receipts.select(F.col(key), "needs_review", F.coalesce(F.col("discrepancia").cast("double"), F.lit(0.0)).alias("discrepancia"), "extracao_json"))
    fields = ("descricao_original", "valor", "desconto_direto", "quantidade", "preco_unitario")
    read = F.transform("extracao.itens", lambda x, i: F.struct(i.alias("pos"), *(x[f].alias(f) for f in fields)))
    out = checked(rows.select(key, "needs_review", "discrepancia", F.col("extracao.iva").alias("iva"), read.alias("linhas")))
    any_ = F.size("erradas") > 0
    out = out.filter(F.col("needs_review") | F.col("pista").isNotNull() | any_)
    return out.select(key, "discrepancia", "iva", "pista", F.when(any_, F.col("erradas")).alias("linhas_inconsistentes"))
