"""A receipt's lines are folded, reconciled and checked within its row, as the operators on exploded lines do, and without a shuffle."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from pricegrain.operators import receipts as rc
from pricegrain.operators import upload
from pricegrain.sources.extractions import lines, parse
from pricegrain.sources.tables import settled

TEXTS = ("POUPANCA", "Desconto 2", "0,816 kg 1,70 EUR/kg", "MACA 1,250 kg x 2,00 EUR/kg", "LEITE", "", None, "  PAO ", "Promoção")


def extractions(spark, n=300):
    r, number = random.Random(7), lambda: r.choice((None, 0.0, 1.0, 2.0, 3.5, -1.0, 4.02))
    line = lambda: r.choice((None, *[{"descricao_original": r.choice(TEXTS), "valor": number(), "desconto_direto": number(), "quantidade": number(), "preco_unitario": number(), "is_clearance": r.choice((None, True))}] * 9))
    texts = [json.dumps({"loja": {"cadeia": "X"}, "total_impresso": number(), "desconto_global": number(), "iva": number(), "itens": [line() for _ in range(r.randrange(7))]}) for _ in range(n)]
    return spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate([*texts, "nada", '{"itens": 3}', "x {\"itens\": []} y"])], "k string, extracao_json string")


def test_same_as_exploded(spark):
    said = extractions(spark)
    read = settled(parse(said).filter("extracao is not null"))
    rows = rc.fold_lines(lines(read, "k"), "k")
    done = rc.reconcile(rows, read.select("k", "extracao.total_impresso", "extracao.desconto_global", "extracao.iva"), "k", empty=True)
    found = settled(upload.judged(said, "k"))
    plain = lambda frame: sorted(map(repr, frame.collect()))
    names = ("subtotal", "convencao", "total_reconciliado", "discrepancia", "bate")
    assert plain(found.select("k", *names)) == plain(done.select("k", *names))
    columns = ("k", "pos", "descricao_original", "linha_peso", "valor", "desconto_direto", "quantidade", "preco_unitario", "is_clearance")
    assert plain(found.select("k", F.inline("linhas")).select(*columns)) == plain(rows.select(*columns))
    assert plain(found.select("k", F.inline("precos"))) == plain(done.select("k", F.inline("itens")))
    told = rc.hint(rows, done.select("k", "discrepancia"), "k")
    assert plain(found.filter("pista is not null").select("k", "pista.*")) == plain(told) and told.count()
    wrong = rc.wrong_lines(rows).groupBy("k").agg(F.count(F.lit(1)).alias("n_fora"), F.min_by(F.struct("descricao_original", "quantidade", "preco_unitario", "valor", "esperado"), "pos").alias("fora"))
    assert plain(found.filter("n_fora > 0").select("k", "n_fora", "fora")) == plain(wrong) and wrong.count()


def test_no_shuffle(spark):
    plan = upload.judged(extractions(spark, 20), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("from_json") == 1


def test_diagnosis_within_rows(spark):
    stored = extractions(spark, 20).withColumns({"discrepancia": F.lit(1.0), "needs_review": F.lit(True)})
    plan = rc.diagnosis(stored, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("from_json") == 1
