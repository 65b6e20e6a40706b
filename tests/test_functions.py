from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricegrain.functions import text, units

FORMATS = [
    ("BOL DIGESTIVE AVEIA CNT 425GR", 1.39, 1, None, "kg", 0.425, 3.2706),
    ("MANTEIGA C/ SAL CONTINENTE 250G", 1.99, 1, None, "kg", 0.25, 7.96),
    ("IOG MYTHOS CNT COCO 4X115G", None, 1, None, "kg", 0.46, 0.0),
    ("LOMBINHOS DE FRANGO 0,540 kg x 6,19 EUR/kg", 3.34, 1, None, "kg", 0.54, 6.19),
    ("BANANA 2,426 kg 1,20 €/kg", 2.91, 1, None, "kg", 2.426, 1.2),
    ("ARO ARROZ LONGO COMUM 2K", 2.5, 1, None, "kg", 2.0, 1.25),
    ("LEITE UHT 1LT", 1.0, 1, None, "L", 1.0, 1.0),
    ("AGUA 330 ML", 0.33, 1, None, "L", 0.33, 1.0),
    ("BANANA 1,170 X 1,29", 1.51, 1, None, "kg", 1.17, 1.29),
    ("CREPES CONTINENTE SIMPLES 16UN", 3.99, 1, None, "un", 16.0, 0.2494),
    ("NATAS PARA CULINARIA", 0.79, 1, None, "un", 1.0, 0.79),
    ("AZEITE VR SELECÇÃO PT 0,75L", 5.39, 1, None, "L", 0.75, 7.1867),
    ("CAFE NOIDO ENCORPADO", 2.95, 1, "kg", "un", 1.0, None),
    ("OVOS SOLO CLASSE M/L CNT 18UN", 4.79, 1, "un", "un", 18.0, 0.2661),
    ("MARMELADA CONTINENTE 500G", 2.37, 0.5, "kg", "kg", 0.5, 4.74),
    ("ALPERCE", 2.05, 0.514, "kg", "un", 1.0, 3.9883),
    ("MEIA DÚZIA DE OVOS", 1.2, 1, None, "un", 6.0, 0.2),
    ("24 OVOS", 4.8, 1, None, "un", 24.0, 0.2),
    (None, 1.0, None, None, "un", 1.0, 1.0),
]


def test_formats_and_prices(spark):
    rows = spark.createDataFrame([(i, r[0], r[1], None if r[2] is None else float(r[2]), r[3]) for i, r in enumerate(FORMATS)], "i int, d string, p double, q double, alvo string")
    pack = units.pack_format(F.col("d"))
    found = rows.select("i", pack.alias("f"), units.price_per_base(F.col("p"), F.col("q"), pack, F.col("alvo")).alias("x")).orderBy("i").collect()
    for (d, _, _, _, unit, value, price), r in zip(FORMATS, found, strict=True):
        assert (r["f"]["unidade_base"], r["f"]["formato_valor"]) == (unit, pytest.approx(value)), d
        assert r["x"] == (None if price is None else pytest.approx(price)), d


def test_similarity(spark):
    pairs = [("Parmigiano Reggiano", "Parmigiano Reggiano DOP 24 Meses"), ("Ovos de Galinha", "Ovos de Galinha Criada no Solo"), ("Natas para Culinária", "Natas para Culinária"), ("Queijo", "Queijo Gouda"), ("Manteiga com Sal", "Queijo Gouda"), ("Pão com Nozes", "Pao com Nozes"), ("", "x"), (None, None)]
    found = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert found[0] >= 0.9 and found[1] >= 0.9 and found[2] == 1 and found[3] < 0.85 and found[4] < 0.4 and found[5] == 1 and found[6] == 0 and found[7] == 0


def test_term_similarity(spark):
    pairs = [("manteigas", "Manteiga com Sal"), ("iorgute", "Iogurte Natural"), ("leit", "Leite UHT Meio-Gordo"), ("iogurte", "Iogurte Natural"), ("manteigas", "Queijo Gouda"), ("banana", "Mostarda Dijon")]
    found = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text.term_similarity(F.col("a"), F.col("b"))).collect()]
    assert all(x >= 0.7 for x in found[:4]) and found[3] == 1 and all(x < 0.7 for x in found[4:])


def test_targets():
    assert {"vinho", "cerveja", "garrafeira"} <= set(text.expand_target("bebida alcoólica"))
    assert text.expand_target("vinho") == ["vinho"] and text.expand_target("leite meio gordo") == ["leite meio gordo"]


def test_names(spark):
    rows = spark.createDataFrame([("BOL C/ QJ", "FARMACIA CENTRAL", "Enchidos"), ("IOG CNT", "LIDL & CIA", None)], "d string, n string, c string")
    a, b = rows.select(text.expand_abbreviations(F.col("d")), text.split_chain(F.col("d")), text.store_kind(F.lit(None).cast("string"), F.col("n")), text.section(F.col("c"))).collect()
    assert tuple(a) == ("Bolacha com Queijo", ("BOL C/ QJ", None), "farmacia", "Charcutaria")
    assert tuple(b) == ("Iogurte CNT", ("IOG", "CNT"), "supermercado", "Outros")
