"""Search by posting lists against LIKE and measuring all; exact medians of groups beyond the buffer; database reads."""

from __future__ import annotations

import random
from dataclasses import replace
from statistics import median

import pytest
from pyspark.sql import functions as F

from pricegrain.functions.text import contains_pattern, fold
from pricegrain.operators import search, star
from pricegrain.operators.median import medians
from pricegrain.schemas import TABLES, schema
from pricegrain.sources.adapter import store
from pricegrain.sources.tables import id_ranges, read_jdbc

TEXTS = ["Pão de Forma", "PAO INTEGRAL", "pa", "", " x ", "Água 50% gás", "a_b", "Leite Meio-Gordo 1L", "leite\nUHT", "Ação e reacção", "ab", "banana banana", None, "Pão de Forma", "Ｐão 𝔘 pão"]
TERMS = ["pão", "PAO", "pa", "p", "leite", "50%", "a_b", "l%te", "banana b", "nada disto", "acao", " ", "é", "Leite meio-gordo 1l", "%", "ã%o%ma"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "descricao_original string")


def test_lists_find_what_like_finds(texts):
    lists = search.text_lists(texts).persist()
    for term in TERMS:
        want = {r[0] for r in texts.filter(fold(F.col("descricao_original")).like(contains_pattern(term))).collect()}
        found = [r[0] for r in search.texts_with(lists, [term]).collect()]
        assert set(found) == want and len(found) == len(want), term
    both = [r[0] for r in search.texts_with(lists, ["pao", "leite"]).collect()]
    assert len(both) == len(set(both)) == 5
    assert not search.text_lists(texts.limit(0)).count()


def test_later_texts(spark, texts):
    lists = search.text_lists(texts)
    more = search.new_text_lists(lists, spark.createDataFrame([("Pão de Forma",), ("Pão novo",), (None,)], "descricao_original string"))
    assert {r[0] for r in more.select("texto").distinct().collect()} == {"Pão novo"}


@pytest.mark.parametrize("least", [0.7, 0.5, 0.9, 0.3, 1.0])
def test_spelling_loses_no_word(spark, least):
    rng = random.Random(5)
    base = ["leite", "banana", "iogurte", "abcdefghij", "aaaaaaaa", "ab", "a", "abc"]
    words = set(base)
    for _ in range(600):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k, at = rng.randint(0, 2), rng.randrange(len(w) + 1)
            w[at : at + (k > 0)] = [rng.choice("abeil")] if k < 2 else []
        words.add("".join(w))
    frame = spark.createDataFrame([(w,) for w in words if w], "palavra string").persist()
    lists = search.word_lists(frame).persist()
    for term in ["leite", "lete", "banana", "abcdefghij", "aaaaaaa", "ab", "a", "zzzz", "iogurtes"]:
        longer = F.greatest(F.length("palavra"), F.lit(len(term)))
        want = {(r[0], r[1]) for r in frame.select("palavra", (1.0 - F.levenshtein("palavra", F.lit(term)) / longer).alias("s")).filter(F.col("s") >= least).collect()}
        assert {(r[0], r[1]) for r in search.words_like(lists, term, least).collect()} == want, term
    assert not search.words_like(lists, "", least).count()


def test_store_with_index(spark, sf_dir, tmp_path):
    plain = store(spark, sf_dir)
    search.write_index(search.search_index(plain.item, plain.sku_normalizado), str(tmp_path))
    indexed = replace(plain, indice=search.read_index(spark, str(tmp_path)))
    for term in ("widget", "red plate", "widgt", "500g", "bebida", "xyzzy", "un", "ólt"):
        one, other = (star.match_product(s, term).select("item_id", "sku_id", "loja").collect() for s in (plain, indexed))
        assert sorted(map(str, one)) == sorted(map(str, other)), term
    for term in ("widgt", "plat", "Plâte", "b-o-l-t", "!!"):
        one, other = (star.similar_products(s, term).collect() for s in (plain, indexed))
        assert sorted(map(str, one)) == sorted(map(str, other)), term
    plan = search.texts_with(indexed.indice.textos, ["widget"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(grama" in plan
    lines = star.match_product(indexed, "widget")._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(descricao_original" not in lines and "lower(texto" in lines


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_medians(spark, most):
    rng = random.Random(3)
    groups = {
        1: [rng.uniform(0, 9) for _ in range(3001)],
        2: [float(rng.randint(1, 6)) for _ in range(2000)],
        3: [1e300, *(10.0 ** rng.randint(-300, 300) for _ in range(999))],
        4: [2.0] * 1500 + [3.0] * 1500,
        5: [7.5],
        6: [1.0, 2.0],
        7: [float(i) for i in range(500)],
        8: [-1.0] * 10 + [0.0] * 999,
        9: [1.0, 1.0, 1.0, 2.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [(1, None), (None, 3.0), (10, None)]
    rng.shuffle(rows)
    found = {r["sku"]: (r["mediana"], r["n"]) for r in medians(spark.createDataFrame(rows, "sku long, v double"), "sku", "v", most).collect()}
    assert found.keys() == groups.keys()
    for k, values in groups.items():
        assert found[k] == (pytest.approx(median(values), rel=1e-15), len(values)), k
    assert not medians(spark.createDataFrame([], "sku long, v double"), "sku", "v", most).count()


def test_id_ranges(spark):
    crowded = spark.range(4000).select((F.col("id") + 10**12).alias("id")).unionByName(spark.range(10)).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id")))
    ranges = id_ranges(crowded, 8)
    sizes = [crowded.filter(r).count() for r in ranges]
    assert sum(sizes) == 4011 and max(sizes) <= 2 * 4011 / len(ranges) and len(ranges) == 8
    assert id_ranges(crowded.limit(0), 8) == ["1 = 1"] == id_ranges(crowded, 1)


def test_database(spark, tmp_path):
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = f"jdbc:derby:{tmp_path}/db"
    rows = spark.range(3000).select(F.when(F.col("id") < 20, F.col("id")).otherwise(F.col("id") + 10**11).alias("id"), F.lit("Loja").alias("cadeia"))
    for name, columns in TABLES.items():
        first = columns.split()[0]
        frame = rows if name == "loja" else spark.createDataFrame([], "id long") if first == "id" else spark.createDataFrame([], "descricao_original string")
        frame.write.mode("append").jdbc(f"{url};create=true", name, properties=options)
    found = read_jdbc(spark, url, 6, **options)
    sizes = [r[0] for r in found.loja.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 3000 and len(sizes) == 6 and max(sizes) <= 1000
    assert found.loja.schema.fieldNames() == schema("loja").fieldNames() and not found.fatura.count() and not found.sku_alias.count()
