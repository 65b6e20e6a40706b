from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import dml, receipts, resolve
from pricegrain.plans import admin, explorer, purchases, tools
from pricegrain.sources import tables
from pricegrain.sources.tables import Store, complete
from pricegrain.streaming import arrivals

LINE = "f int, pos int, descricao_original string, valor double, desconto_direto double, quantidade double, preco_unitario double"


@pytest.fixture(scope="module")
def shop(spark):
    make = lambda name, rows, ddl: complete(spark.createDataFrame(rows, ddl), name)
    stores = make("loja", [(1, "Continente", "Continente ZZ", "A"), (2, "Pingo Doce", "Pingo Doce ZZ", "B")], "id long, cadeia string, nome string, nif string")
    products = make("sku_normalizado", [(1, "Manteiga ZZ", "Mimosa", "ZZ_Laticinios", "un"), (2, "Café ZZ", "Delta", "ZZ_Cafes", "kg")], "id long, nome_canonico string, marca string, categoria string, unidade_base string")
    bills = spark.createDataFrame([(1, 1, "2099-05-01 10:00:00"), (2, 2, "2099-05-28 18:30:00"), (3, 1, "2099-05-15 11:00:00")], "id long, loja_id long, t string").withColumn("data_compra", F.to_timestamp_ntz("t")).withColumn("criado_em", F.col("data_compra")).withColumn("needs_review", F.lit(False))
    lines = [(1, 1, 1, "MANT ZZ 250G", 2.39, 2.39, False, False), (2, 1, 2, "CAFE ZZ 250G", 3.5, 14.0, False, False), (3, 2, 1, "MANTEIGA ZZ", 2.19, 2.19, False, False), (4, 2, 2, "CAFE ZZ", 3.2, 12.8, False, False), (5, 2, None, "SACO ZZ", 0.1, None, False, True), (6, 3, 1, "MANT ZZ -50%", 1.0, 1.0, True, False)]
    items = make("item", lines, "id long, fatura_id long, sku_id long, descricao_original string, preco_liquido double, preco_por_base double, is_clearance boolean, is_non_product boolean")
    return Store(stores, products, complete(bills, "fatura"), items)


def test_questions(shop):
    year = {"periodo_inicio": "2099-01-01", "periodo_fim": "2099-12-31"}
    last = purchases.last_purchase(shop, "Manteiga").collect()
    assert [(r["cadeia"], float(r["preco"]), r["data"]) for r in last] == [("Pingo Doce", 2.19, "2099-05-28")]
    assert [(r["cadeia"], float(r["preco_por_base"])) for r in purchases.compare_stores(shop, "manteiga").collect()] == [("Pingo Doce", 2.19), ("Continente", 2.39)]
    assert [r["data"] for r in purchases.price_history(shop, "MANTEIGA").collect()] == ["2099-05-01", "2099-05-28"]
    assert purchases.price_history(shop, "Manteiga", "2099-05-10").count() == 1
    total = lambda **a: tuple(map(float, purchases.total_spent(shop, **a, **year).select("total", "n_itens").first()))
    assert total(alvo="Café") == (6.7, 2) and total(alvo="tudo") == (12.28, 5) and total(alvo="tudo", loja="pingo") == (5.39, 2)
    assert total(alvo="zz_laticinios") == (5.58, 3)
    assert total(alvo="Manteigga") == (5.58, 3)  # by its spelling
    assert purchases.list_purchases(shop, **year).count() == 5
    by = purchases.list_purchases(shop, **year, agrupar_por="produto").collect()
    assert {(r["produto"], r["vezes"], float(r["total"])) for r in by} == {("Café ZZ", 2, 6.7), ("Manteiga ZZ", 3, 5.58)}
    habits = purchases.habitual_products(shop, 2, "2099-01-01", "2099-12-31").collect()
    assert [(r["produto"], r["idas"]) for r in habits] == [("Manteiga ZZ", 3), ("Café ZZ", 2)]
    details = purchases.receipt_details(shop, None, "2099-05-01").first()
    assert len(details["itens"]) == 2 and all(i["preco"] is not None for i in details["itens"])
    assert purchases.receipt_details(shop, "nowhere").count() == 0
    assert float(purchases.cheapest_products(shop, "Manteiga").first()["preco_por_base"]) == 2.19


def test_tools(shop):
    asked = iter([{"tool_calls": [{"name": "total_gasto", "arguments": '{"alvo": "Café", "periodo_fim": "2099-12-31"}'}, {"name": "none", "arguments": "{"}]}, {"content": "done"}])
    seen: list = []

    def planner(messages):
        seen[:] = messages
        return next(asked)

    assert tools.answer(shop, "?", planner) == "done"
    assert '"total": 6.7' in seen[-2]["content"] and "erro" in seen[-1]["content"]
    assert len(tools.definitions()) == 9


def test_fold_lines(spark):
    rows = [(1, 0, "BOL 150G", 1.38, None), (1, 1, "POUPANCA", 0.47, None), (1, 2, "COCO", 1.99, None), (2, 0, "1 BANANA", 1.81, None), (2, 1, "2,426 kg 1,20 EUR/kg", 2.91, None), (2, 2, "1 BATATA VERMELHA", 0.0, None), (2, 3, "0,816 kg 1,70 €/kg", 1.39, None), (3, 0, "BANANA\n1,800 kg x 1,19 EUR/kg", 2.14, None), (4, 0, "BANANA 1,170 X 1,29", 1.51, None), (5, 0, "DESCONTO", 1.0, None)]
    found = receipts.fold_lines(spark.createDataFrame([(*r, None, None) for r in rows], LINE), "f").orderBy("f", "pos").collect()
    assert [(r["f"], r["descricao_original"], r["valor"], r["desconto_direto"], r["linha_peso"]) for r in found] == [
        (1, "BOL 150G", 1.38, 0.47, None),
        (1, "COCO", 1.99, None, None),
        (2, "1 BANANA", 2.91, None, "2,426 kg 1,20 EUR/kg"),
        (2, "1 BATATA VERMELHA", 1.39, None, "0,816 kg 1,70 €/kg"),
        (3, "BANANA", 2.14, None, "1,800 kg x 1,19 EUR/kg"),
        (4, "BANANA", 1.51, None, "1,170 X 1,29"),
        (5, "DESCONTO", 1.0, None, None),
    ]


def test_reconcile_and_hints(spark):
    rows = [(1, 0, "a", 3.49, None), (1, 1, "b", 2.29, None), (1, 2, "c", 3.59, None), (2, 0, "x", 30.0, None), (2, 1, "y", 19.12, None), (3, 0, "g", 3.13, 0.2), (3, 1, "h", 2.0, None), (4, 0, "d", 7.77, None), (4, 1, "e", 7.77, None)]
    lines = spark.createDataFrame([(*r, None, None) for r in rows], LINE)
    totals = spark.createDataFrame([(1, 9.27, 0.0, 0.0), (2, 56.89, 0.0, 7.77), (3, 4.93, 0.0, 0.0), (4, 7.77, 0.0, 0.0)], "f int, total_impresso double, desconto_global double, iva double")
    done = receipts.reconcile(lines, totals, "f")
    found = {r["f"]: r for r in done.collect()}
    assert (found[1]["discrepancia"], found[1]["bate"]) == (0.1, False)
    assert (found[2]["total_reconciliado"], found[2]["bate"], found[2]["itens"][0]["preco_liquido"]) == (56.89, True, 30.0)
    assert (found[3]["convencao"], found[3]["bate"], found[3]["itens"][0]["preco_liquido"], found[3]["itens"][0]["preco_unitario"]) == ("B", True, 2.93, 3.13)
    hints = {r["f"]: (r["tipo"], r["linha"]) for r in receipts.hint(lines, done.select("f", "discrepancia"), "f").collect()}
    assert hints == {1: ("ACIMA", None), 4: ("DUPLICADO", "d")}


def test_wrong_lines(spark):
    rows = [(1, 0, "ok", 1.18, None, 2.0, 0.59), (1, 1, "bad", 0.59, None, 2.0, 0.59), (1, 2, "one", 5.0, None, 1.0, 2.0), (1, 3, "none", 5.0, None, 3.0, None)]
    found = receipts.wrong_lines(spark.createDataFrame(rows, LINE)).collect()
    assert [(r["descricao_original"], r["esperado"]) for r in found] == [("bad", 1.18)]


def test_resolve(spark):
    texts = spark.createDataFrame([("MANT ZZ",), ("mant zz ",), ("MANT NOVA",), ("ILEGIVEL",), ("PARM DOP",), ("NOVA COISA",), ("NOVA COISA 2",)], "descricao_original string")
    canon = spark.createDataFrame([("MANT NOVA", "Manteiga com Sal", "M", "L", "kg", 0.9), ("ILEGIVEL", "?", None, None, "un", 0.2), ("PARM DOP", "Parmigiano Reggiano DOP", None, "Q", "kg", 0.9), ("NOVA COISA", "Coisa Nova", None, "X", "un", 0.9), ("NOVA COISA 2", "Coisa Nova", None, "X", "un", 0.9)], "descricao_original string, nome_canonico string, marca string, categoria string, unidade_base string, confianca double").withColumn("formato_valor", F.lit(None).cast("decimal(10,3)"))
    products = spark.createDataFrame([(1, "Manteiga com Sal", "M", "kg"), (2, "Parmigiano Reggiano", None, "kg")], "id long, nome_canonico string, marca string, unidade_base string").withColumn("formato_valor", F.lit(None).cast("decimal(10,3)"))
    aliases = spark.createDataFrame([("MANT ZZ", 1)], "descricao_original string, sku_id long")
    found = {r["descricao_original"]: (r["via"], r["sku_id"], r["representante"]) for r in resolve.resolve(texts, aliases, canon, products).collect()}
    assert found == {"MANT ZZ": ("alias", 1, None), "MANT NOVA": ("match", 1, None), "ILEGIVEL": ("revisao", None, None), "PARM DOP": ("match", 2, None), "NOVA COISA": ("novo", None, "nova coisa"), "NOVA COISA 2": ("match", None, "nova coisa")}


def test_changes(spark, shop):
    ddl = "id long, loja_id long, numero_fatura string, data_compra string, total_impresso double"
    old = spark.createDataFrame([(1, 1, "A", "2099-01-01", 5.0), (2, 1, None, "2099-01-02", 6.0)], ddl)
    new = spark.createDataFrame([(3, 1, "A", "2099-02-01", 7.0), (4, 1, None, "2099-01-02", 6.0), (5, 1, None, "2099-03-01", 8.0), (6, 1, None, "2099-03-01", 8.0), (7, 2, "A", "2099-01-01", 5.0)], ddl)
    assert sorted(r["id"] for r in dml.new_receipts(new, old).collect()) == [5, 7]
    facts = spark.createDataFrame([("u", "É vegetariano")], "utilizador string, fato string")
    again = dml.remember(dml.remember(facts, "u", "e vegetariano"), "u", "outro")
    assert again.count() == 2 and dml.forget(again, "u", "OUTRO").count() == 1
    left = dml.delete_receipts(shop.fatura, shop.item, spark.createDataFrame([(1, 1)], "id long, fatura_id long"), shop.sku_normalizado, spark.createDataFrame([("x", 2)], "descricao_original string, sku_id long"), spark.createDataFrame([(1,), (2,)], "id long"))
    assert {k: v.count() for k, v in left.items()} == {"fatura": 1, "item": 1, "revisao": 0, "sku_normalizado": 1, "sku_alias": 0}
    mapping = spark.createDataFrame([(2, 1)], "de long, para long")
    items, _, products = dml.merge(shop.item, spark.createDataFrame([("x", 2)], "descricao_original string, sku_id long"), shop.sku_normalizado, mapping)
    assert items.filter("sku_id = 1").count() == 5 and products.count() == 1


def test_stream(spark, tmp_path, shop):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    shop.fatura.write.parquet(folder)
    query = arrivals.ingest(arrivals.arriving(spark, folder), None, target, str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(target).count() == 3


def test_duplicates_in_order(spark):
    """What equals only a dropped receipt stays; ids are no numbers; what is missing equals nothing."""
    ddl = "id long, loja_id long, numero_fatura string, data_compra string, total_impresso double"
    none = spark.createDataFrame([], ddl)
    ids = lambda rows, old=none: sorted(r["id"] for r in dml.new_receipts(spark.createDataFrame(rows, ddl), old).collect())
    assert ids([(1, 1, "A", "d1", 1.0), (2, 1, "A", "d2", 2.0), (3, 1, "B", "d2", 2.0)]) == [1, 3]
    assert ids([(5, 1, None, "d1", 1.0), (6, 1, "5", "d2", 2.0)]) == [5, 6]
    assert ids([(1, 1, "A", "d1", None), (2, 1, "B", "d1", None), (3, 1, None, None, 1.0), (4, 1, None, None, 1.0)]) == [1, 2, 3, 4]
    assert ids([(7, 1, " a ", "d3", 3.0), (8, 2, "A", "d1", 1.0)], spark.createDataFrame([(1, 1, "A", "d1", 1.0)], ddl)) == [8]
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.choice([None, *"ABCDEFGH"]), rng.choice([None, "d1", "d2", "d3", "d4"]), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(120)]
    kept: list = []
    for r in rows:
        if not any(k[1] == r[1] and (r[2] is not None and k[2] == r[2] or None not in (r[3], r[4]) and k[3:] == r[3:]) for k in kept):
            kept.append(r)
    assert ids(rows) == [r[0] for r in kept]


def test_stores_of_an_upload(spark):
    ddl = "id long, cadeia string, nome string, nif string, tipo string"
    old = spark.createDataFrame([(1, "Aldi", "Aldi Norte", "N1", "supermercado"), (2, "Lidl", "Lidl Sul", None, "supermercado")], ddl)
    new = spark.createDataFrame([("a", "X", "Y", "N1"), ("b", "lidl", "LIDL SUL", None), ("c", None, None, None), ("d", "Farmácia", "Centro", "N9"), ("e", "Farmácia", "Centro", " "), ("f", "Lidl", "Lidl Sul", "N7")], "k string, cadeia string, nome string, nif string")
    stores, found = dml.upsert_stores(new, old)
    known = {r["id"]: (r["nome"], r["nif"], r["tipo"]) for r in stores.collect()}
    at = {r["k"]: r["loja_id"] for r in found.collect()}
    assert at["a"] == 1 and at["b"] == 2 and at["d"] == at["e"] and at["f"] not in (1, 2)
    assert known[at["c"]] == ("Desconhecida", None, "outro") and known[at["d"]] == ("Centro", "N9", "farmacia") and len(known) == 5


def test_products_and_appended_rows(spark, shop):
    aliases = spark.createDataFrame([("x", 2, "llm"), ("y", 1, "llm")], "descricao_original string, sku_id long, origem string")
    _, moved, products = dml.merge_two(shop.item, aliases, shop.sku_normalizado, 2, 1)
    assert sorted((r["sku_id"], r["origem"]) for r in moved.collect()) == [(1, "llm"), (1, "manual")] and products.count() == 1
    for wrong, error in (((1, 1), ValueError), ((1, 99), LookupError)):
        with pytest.raises(error):
            dml.merge_two(shop.item, aliases, shop.sku_normalizado, *wrong)
    products, items = dml.edit_product(shop.sku_normalizado, shop.item, 1, unidade_base="kg", marca="Nova")
    assert {r["id"]: float(r["preco_por_base"]) for r in items.filter("sku_id = 1 and preco_por_base is not null").collect()} == {1: 9.56}
    assert products.filter("id = 1").first()["marca"] == "Nova" and items.count() == shop.item.count()
    names = spark.createDataFrame([(1, "Café, Moído"), (2, "cafe moido"), (3, "Chá"), (4, "cha"), (5, "--"), (6, "-")], "id long, nome_canonico string")
    pairs = lambda **a: sorted(tuple(r) for r in dml.identical_names(names, shop.item, **a).collect())
    assert pairs() == [(2, 1), (4, 3)] and pairs(names=names.filter("id = 4")) == [(4, 3)]
    told = dml.append_message(complete(spark.createDataFrame([(7, "u")], "id long, utilizador string"), "mensagem"), "u", "user", "z" * 5000)
    assert [(r["id"], len(r["conteudo"] or "")) for r in told.orderBy("id").collect()] == [(7, 0), (8, 4000)]
    reviews = dml.append_review(complete(spark.createDataFrame([], "id long"), "revisao"), 3, "erro", "c")
    assert [(r["id"], r["fatura_id"], r["veredicto"]) for r in reviews.collect()] == [(1, 3, "erro")]
    with pytest.raises(ValueError):
        dml.append_review(reviews, 3, "talvez")
    calls = complete(spark.createDataFrame([(4,)], "id long"), "custo_chamada")
    assert dml.append_cost(calls, None, "m", None).count() == 1
    assert [(r["id"], r["contexto"], float(r["custo"])) for r in dml.append_cost(calls, None, "m", {"prompt_tokens": 5, "cost": 0.25}).filter("id = 5").collect()] == [(5, "geral", 0.25)]


def test_diagnosis(spark):
    rows = [
        (1, True, 0.0, '{"itens": [{"descricao_original": "a", "valor": 1.0}]}'),
        (2, False, 0.0, '{"itens": [{"descricao_original": "a", "valor": 1.0}]}'),
        (3, False, 2.0, '{"iva": 0.3, "itens": [{"descricao_original": "a", "valor": 1.0}, {"descricao_original": "b", "valor": 2.0}]}'),
        (4, False, 0.0, '{"itens": [{"descricao_original": "a", "valor": 1.0, "quantidade": 3, "preco_unitario": 1.0}]}'),
        (5, True, 1.0, "no json"),
        (6, True, 1.0, None),
    ]
    found = {r["id"]: r for r in receipts.diagnosis(spark.createDataFrame(rows, "id long, needs_review boolean, discrepancia double, extracao_json string")).collect()}
    assert sorted(found) == [1, 3, 4]
    assert (found[3]["pista"]["tipo"], found[3]["pista"]["linha"], found[3]["iva"]) == ("DUPLICADO", "b", 0.3)
    assert [x["esperado"] for x in found[4]["linhas_inconsistentes"]] == [3.0] and found[1]["pista"] is None


def test_small_forms(spark):
    row = spark.createDataFrame([("2024-03-05T10:20:30.5Z", "2024-03-05", "x", 1234.5)], "t string, d string, w string, e double")
    got = row.select(*(receipts.purchase_time(F.col(c)).cast("string") for c in "tdw"), explorer.euros(F.col("e")), explorer.short_day(F.col("d").cast("date"), True)).first()
    assert tuple(got) == ("2024-03-05 10:20:30", "2024-03-05 00:00:00", None, "1234,50", "05/03/24")
    assert [tables.audio_format(m) for m in ("audio/aac", "audio/flac", "audio/mpeg", "", "audio/webm;codecs=opus", "audio/mp4")] == ["m4a", "webm", "mp3", "webm", "webm", "m4a"]
    files = spark.createDataFrame([("a.PDF", None), ("b", "application/pdf"), ("c.bin", "image/heic"), ("d.wav", None), ("e", None)], "p string, m string")
    assert [r[0] for r in files.select(tables.file_kind(F.col("p"), F.col("m"))).collect()] == ["pdf", "pdf", "imagem", "voz", "outro"]
    lines = spark.createDataFrame([(1, "p", 2.0, 0, 2), (1, "q", 1.0, 1, None), (1, "p", 2.0, 2, 3)], "f int, produto string, preco double, pos int, qtd int")
    assert [(r["produto"], r["qtd"]) for r in explorer.same_lines(lines, "f").collect()] == [("p", 5), ("q", 1)]
    first, rest = explorer.first_and_rest(lines, "f", "pos", 2)
    assert (first.count(), rest.count(), explorer.cart_total(lines).first()["total"]) == (2, 1, 5.0)
    assert text_of(spark, "C/ SAL S/GLUTEN QJ UN") == "com SAL sem GLUTEN Queijo unidades"


def text_of(spark, value):
    from pricegrain.functions.text import expand_abbreviations

    return spark.range(1).select(expand_abbreviations(F.lit(value))).first()[0]


def test_outliers_and_explorer(spark, shop):
    rows = [(i, 1, 1, p) for i, p in enumerate((0.0, 0.0, 0.0, 1.0, 1.0, 4.0, 0.25))]
    priced = complete(spark.createDataFrame(rows, "id long, fatura_id long, sku_id long, preco_por_base double").withColumns({"is_non_product": F.lit(False), "is_clearance": F.lit(False), "preco_liquido": F.lit(9.5)}), "item")
    found = admin.price_outliers(Store(shop.loja, shop.sku_normalizado, shop.fatura, priced))
    assert sorted((float(r["preco_por_base"]), r["mediana"], r["desvio"]) for r in found.collect()) == [(0.25, 1.0, 0.3), (4.0, 1.0, 4.0)]
    assert [(r["mes"], r["n"]) for r in explorer.months(shop).collect()] == [("2099-05", 3)]
    listed = explorer.products(shop).collect()
    assert [(r["nome_canonico"], r["n_compras"], float(r["ultimo_preco"])) for r in listed] == [("Manteiga ZZ", 3, 2.19), ("Café ZZ", 2, 3.2)]
    assert [(r["data"], r["promo"]) for r in explorer.product_history(shop, 1).collect()] == [("2099-05-01", False), ("2099-05-15", True), ("2099-05-28", False)]


def test_reprocess(spark, shop):
    said = '{"total_impresso": 5.5, "itens": [{"descricao_original": "MANT ZZ 250G", "valor": 3.0}, {"descricao_original": "POUPANCA", "valor": 0.5}, {"descricao_original": "SACO", "valor": 3.0, "is_non_product": true}]}'
    again = spark.createDataFrame([(1, said), (2, "unreadable")], "id long, extracao_json string")
    aliases = spark.createDataFrame([("mant zz 250g", 1)], "descricao_original string, sku_id long")
    bills, items = dml.reprocess(shop.fatura, shop.item, again, aliases, shop.sku_normalizado)
    bill = bills.filter("id = 1").first()
    assert (float(bill["total_impresso"]), float(bill["total_reconciliado"]), bill["needs_review"], bill["loja_id"]) == (5.5, 5.5, False, 1)
    assert [(r["id"], r["sku_id"], r["descricao_original"], float(r["preco_liquido"]), r["preco_por_base"] and float(r["preco_por_base"])) for r in items.filter("fatura_id = 1").orderBy("id").collect()] == [(7, 1, "MANT ZZ 250G", 2.5, 2.5), (8, None, "SACO", 3.0, None)]
    assert bills.count() == 3 and items.count() == 6 and bills.filter("id = 2").first()["needs_review"] is False


def test_steps_are_asked_again(spark, tmp_path):
    from pricegrain.sources import extractions

    for name in ("a.pdf", "b.png"):
        (tmp_path / name).write_bytes(b"x")
    said: dict = {}

    def step(content, kind):
        said[kind] = said.get(kind, 0) + 1
        return '```{"itens": []}```' if kind == "pdf" and said[kind] == 2 else "no receipt"

    found = {r["path"][-5:]: r["extracao"] for r in extractions.extracted(tables.read_files(spark, str(tmp_path)), step).collect()}
    assert found["a.pdf"] is not None and found["b.png"] is None


def test_names_and_note_of_an_upload(spark, shop):
    items = spark.createDataFrame([(1, 7, "A", 1), (2, 7, "A", 2), (3, 7, "B", None), (4, 8, "A", 1)], "id long, fatura_id long, descricao_original string, sku_id long")
    lines = items.select("fatura_id", "id", "descricao_original")
    found = receipts.named_lines(lines, items, shop.sku_normalizado).orderBy("id").collect()
    assert [r["produto"] for r in found] == ["Café ZZ", "Café ZZ", "B", "Manteiga ZZ"]
    row = spark.createDataFrame([(None, "Loja", "2024-03-05T10:00", 12.5, 3, True), ("C", "x", None, 1.0, 0, None)], "c string, n string, d string, t double, k int, b boolean")
    notes = [r[0] for r in row.select(receipts.upload_note(*(F.col(c) for c in "cndtkb"))).collect()]
    assert notes == ["📄 Loja, 2024-03-05, total 12,50 €, 3 itens.", "📄 C, , total 1,00 €, 0 itens. (em revisão — diferença a confirmar)"]


def test_costs_arrive(spark, tmp_path):
    calls = spark.sql("select cast(null as string) contexto, 'm' modelo, named_struct('prompt_tokens', 5L, 'completion_tokens', cast(null as bigint), 'cost', 0.25D) usage, timestamp_ntz'2024-01-01 00:00:00' criado_em union all select repeat('c', 50), null, null, null union all select repeat('c', 50), null, named_struct('prompt_tokens', null, 'completion_tokens', 2L, 'cost', null), null")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        arrivals.log_costs(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = complete(spark.read.parquet(str(tmp_path / "out")), "custo_chamada").collect()
    assert sorted((r["contexto"], r["modelo"], r["prompt_tokens"], r["completion_tokens"], float(r["custo"])) for r in rows) == [("c" * 30, "", 0, 2, 0.0), ("geral", "m", 5, 0, 0.25)]
