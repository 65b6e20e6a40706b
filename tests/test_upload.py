"""Uploads as one commit, the catalog's versions, and corrections against a sequential loop."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import receipts, upload
from pricegrain.sources.catalog import Catalog, Conflict
from pricegrain.sources.tables import Store, complete


def receipt(number, total, lines, chain="Continente", shop="Continente Sul", nif="N1", day="2024-03-05T10:00:00", **more):
    items = [dict(zip(("descricao_original", "valor", "desconto_direto", "quantidade", "preco_unitario"), x, strict=False)) for x in lines]
    return json.dumps({"loja": {"cadeia": chain, "nome": shop, "nif": nif}, "numero_fatura": number, "data_compra": day, "total_impresso": total, "itens": items} | more)


def catalog_of(spark, tmp_path):
    make = lambda name, rows, ddl: complete(spark.createDataFrame(rows, ddl), name)
    stores = make("loja", [(4, "Lidl", "Lidl Norte", None)], "id long, cadeia string, nome string, nif string")
    products = make("sku_normalizado", [(1, "Manteiga com Sal", "M", "L", "kg", 0.25), (2, "Leite Meio Gordo", None, "L", "L", 1.0)], "id long, nome_canonico string, marca string, categoria string, unidade_base string, formato_valor double")
    bills = make("fatura", [(10, 4, "A1", 5.0)], "id long, loja_id long, numero_fatura string, total_impresso double")
    items = make("item", [(7, 10, 1, "MANT 250G", 5.0, False, False)], "id long, fatura_id long, sku_id long, descricao_original string, preco_liquido double, is_clearance boolean, is_non_product boolean")
    aliases = make("sku_alias", [("MANT 250G", 1, "manual")], "descricao_original string, sku_id long, origem string")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    assert upload.first_version(catalog, Store(stores, products, bills, items, aliases)) == 1
    return catalog


def uploads(spark, rows):
    return spark.createDataFrame(rows, "ficheiro string, extracao_json string, utilizador string, metodo_extracao string")


def names(texts):
    """A stand-in for the canonical names of a language model."""
    known = F.when(F.col("descricao_original").startswith("LEITE"), "Leite Meio-Gordo").when(F.col("descricao_original").startswith("BOL"), F.concat(F.lit("Bolacha "), F.coalesce("cadeia", F.lit("?"))))
    return texts.select("descricao_original", known.alias("nome_canonico"), F.lit(None).cast("string").alias("marca"), F.lit("X").alias("categoria"), F.lit(None).cast("string").alias("unidade_base"), F.lit(0.9).alias("confianca"))


def test_upload(spark, tmp_path):
    catalog = catalog_of(spark, tmp_path)
    long = "Z" * 300
    rows = [
        ("a", receipt("B1", 4.0, [("MANT 250G", 2.5), ("POUPANCA", 0.5), ("LEITE 1L", 2.0)]), "u", "vlm"),
        ("b", receipt("B1", 4.0, [("MANT 250G", 4.0)]), "u", "vlm"),  # the number of a
        ("c", "no receipt", "u", "vlm"),
        ("d", receipt("a1", 9.0, [("X", 9.0)], "LIDL", "Lidl norte", None), None, None),  # the number of a stored one
        ("e", receipt(None, 7.0, [(long, 3.0, 0.0, 2.0, 1.0), ("BOL 6X100G", 4.0, 0.0, 2.0)], "Lidl", "Lidl Norte", None, "2024-04-01"), None, "ocr_llm"),
        ("f", receipt("C1", 1.0, []), "u", "vlm"),
    ]
    version, found = upload.ingest(catalog, uploads(spark, rows), canonical=names)
    found = {r["ficheiro"]: r for r in found.collect()}
    assert version == 2 and sorted(found) == ["a", "b", "d", "e", "f"]
    assert [found[k]["duplicada"] for k in "abdef"] == [False, True, True, False, False]
    assert found["b"]["fatura_id"] == found["a"]["fatura_id"] and found["d"]["fatura_id"] == 10 and found["d"]["itens"] is None
    assert (found["a"]["convencao"], found["a"]["extracao_bate"], found["a"]["total_reconciliado"], found["a"]["n_itens"]) == ("B", True, 4.0, 2)
    assert [(i["descricao_original"], i["produto"], float(i["preco_liquido"]), float(i["preco_por_base"])) for i in found["a"]["itens"]] == [("MANT 250G", "Manteiga com Sal", 2.0, 8.0), ("LEITE 1L", "Leite Meio Gordo", 2.0, 2.0)]
    assert found["e"]["needs_review"] and found["e"]["n_fora"] == 1 and found["e"]["loja_id"] == 4
    assert [len(i["descricao_original"]) for i in found["e"]["itens"]] == [200, 10] and float(found["e"]["itens"][1]["preco_por_base"]) == round(4 / 1.2, 4)
    assert (found["f"]["n_itens"], found["f"]["itens"], found["f"]["discrepancia"], found["f"]["needs_review"]) == (0, None, -1.0, True)
    s = catalog.read()
    assert sorted((r["id"], r["numero_fatura"]) for r in s.fatura.collect()) == [(10, "A1"), (11, "B1"), (12, None), (13, "C1")]
    assert s.item.count() == 5 and s.item.select("id").distinct().count() == 5 and s.loja.count() == 2
    assert {r["descricao_original"]: r["sku_id"] for r in s.sku_alias.collect()} == {"MANT 250G": 1, "LEITE 1L": 2, "BOL 6X100G": 3}
    made = s.sku_normalizado.filter("id = 3").first()
    assert (made["nome_canonico"], made["unidade_base"], float(made["formato_valor"])) == ("Bolacha Lidl", "kg", 0.6)
    assert sorted(r["conteudo"] for r in s.mensagem.collect()) == ["📄 Continente, 2024-03-05, total 1,00 €, 0 itens. (em revisão — diferença a confirmar)", "📄 Continente, 2024-03-05, total 4,00 €, 2 itens."]
    kept = json.loads(s.fatura.filter("id = 11").first()["extracao_json"])
    assert kept["loja"]["nif"] == "N1" and [x["descricao_original"] for x in kept["itens"]] == ["MANT 250G", "POUPANCA", "LEITE 1L"]
    assert catalog.read(1).fatura.count() == 1  # readers of the old version go on with it
    again, second = upload.ingest(catalog, uploads(spark, rows), canonical=names)
    assert all(r["duplicada"] for r in second.collect()) and again == 3 and catalog.read().item.count() == 5 and catalog.read().sku_alias.count() == 3


def test_products_of_one_name(spark, tmp_path):
    """Products that an upload gives one name, whatever their units, become the most used of them, in older lines too."""
    catalog = catalog_of(spark, tmp_path)
    named = lambda texts: names(texts).withColumn("nome_canonico", F.lit("manteiga, com sal")).withColumn("unidade_base", F.lit("un"))
    _, found = upload.ingest(catalog, uploads(spark, [("a", receipt("B", 2.0, [("NOVO", 2.0), ("NOVO", 2.0)]), None, None)]), canonical=named)
    s = catalog.read()
    assert s.sku_normalizado.count() == 2 and {r["sku_id"] for r in s.item.collect()} == {3}
    assert {(r["descricao_original"], r["sku_id"]) for r in s.sku_alias.collect()} == {("MANT 250G", 3), ("NOVO", 3)} and found.first()["itens"][0]["produto"] == "manteiga, com sal"


def test_read_again(spark, tmp_path):
    """New texts of a receipt that is read again are resolved too."""
    catalog = catalog_of(spark, tmp_path)
    said = receipt("A1", 6.0, [("LEITE 1L", 2.0), ("BOL 500G", 4.0)])
    assert upload.reread(catalog, spark.createDataFrame([(10, said)], "id long, extracao_json string"), names) == 2
    s = catalog.read()
    assert sorted((r["fatura_id"], r["sku_id"], r["descricao_original"], float(r["preco_por_base"])) for r in s.item.collect()) == [(10, 2, "LEITE 1L", 2.0), (10, 3, "BOL 500G", 8.0)]
    bill = s.fatura.first()
    assert (float(bill["total_impresso"]), bill["numero_fatura"], bill["needs_review"]) == (6.0, "A1", False)
    assert s.sku_normalizado.filter("id = 3").first()["nome_canonico"] == "Bolacha Lidl" and s.sku_alias.count() == 3


def test_failures_change_nothing(spark, tmp_path):
    catalog = catalog_of(spark, tmp_path)
    broken = F.udf(lambda x: 1 // 0, "string")

    def fails(texts):
        return names(texts).withColumn("nome_canonico", broken("descricao_original"))

    row = [("a", receipt("B1", 4.0, [("LEITE 1L", 4.0)]), "u", "vlm")]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        upload.ingest(catalog, uploads(spark, row), canonical=fails)
    with pytest.raises(Exception, match="ZeroDivisionError"):  # the second relation fails when the first is written already
        s = catalog.read()
        catalog.commit(1, {"loja": s.loja, "fatura": s.fatura.withColumn("numero_fatura", broken("numero_fatura"))})
    assert catalog.versions() == [1] and catalog.read().fatura.count() == 1 and catalog.read().loja.count() == 1
    assert catalog.commit(1, {"loja": s.loja}) == 2
    with pytest.raises(Conflict):
        catalog.commit(1, {"loja": s.loja})
    assert catalog.versions() == [1, 2] and catalog.read().loja.count() == 2
    assert len(catalog.clean(keep=1)) >= 3 and catalog.versions() == [2] and catalog.read().loja.count() == 2 and catalog.clean(keep=1) == []
    assert Catalog(spark, str(tmp_path / "none")).read().fatura.count() == 0


def test_corrections(spark):
    """Random tries of random receipts: the same as a loop over each receipt that stops as soon as a try is no better."""
    rng = random.Random(6)
    some = lambda: (rng.choice([0.0, 0.01, 1.0, -2.0, 9.0]), rng.choice([0, 0, 1, 3]))
    first = [(k, rng.choice([None, 5.0, 5.0, 5.0]), *some()) for k in range(200)]
    tries = {(k, n): (k, rng.choice([None, 6.0, 6.0, 6.0]), *some()) for k in range(200) for n in (1, 2, 3) if rng.random() < 0.8}
    ddl = "k int, total_impresso double, discrepancia double, n_fora int"
    asked = []
    table = spark.createDataFrame([(n, *r) for (_, n), r in tries.items()], f"n int, {ddl}")

    def step(open_, number):
        asked.append((number, open_.count()))
        return table.filter(F.col("n") == number).join(open_.select("k"), "k", "left_semi").select("k", "total_impresso", "discrepancia", "n_fora")

    want, open_counts = {}, {1: 0, 2: 0, 3: 0}
    for row in first:
        best, at = row, 0
        for n in (1, 2, 3):
            if not (abs(best[2]) >= 0.015 or best[3] > 0) or best[1] is None:
                break
            open_counts[n] += 1
            new = tries.get((row[0], n))
            if new is None or not abs(new[2]) + new[3] < abs(best[2]) + best[3]:
                break
            best, at = new, n
        want[row[0]] = (*best, at)
    found = receipts.corrected(spark.createDataFrame(first, ddl), step, "k", 3).collect()
    assert {r["k"]: tuple(r) for r in found} == want and len(found) == 200 and dict(asked) == {n: c for n, c in open_counts.items() if c}
    asked.clear()
    clean = spark.createDataFrame([(1, 5.0, 0.0, 0), (2, None, 7.0, 2)], ddl)
    assert receipts.corrected(clean, step, "k").count() == 2 and asked == []


def test_corrected_upload(spark, tmp_path):
    catalog = catalog_of(spark, tmp_path)
    seen = []

    def again(rows, number):
        seen.append([(r["ficheiro"], r["discrepancia"], r["pista"]["tipo"], r["fora"] and r["fora"]["esperado"]) for r in rows.collect()])
        said = F.lit(receipt("B1", 4.0, [("LEITE 1L", 4.0)]) if number == 1 else "never asked")
        return rows.select("ficheiro", said.alias("extracao_json"))

    rows = [("a", receipt("B1", 4.0, [("LEITE 1L", 5.0, 0.0, 3.0, 2.0)]), None, None), ("b", receipt("B2", 1.0, [("LEITE 1L", 1.0)]), None, None)]
    _, found = upload.ingest(catalog, uploads(spark, rows), again=again, canonical=names)
    assert seen == [[("a", 1.0, "ACIMA", 6.0)]] and {r["ficheiro"]: r["extracao_bate"] for r in found.collect()} == {"a": True, "b": True}
