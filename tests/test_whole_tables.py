"""Registered queries without SQL against plain Python, over the whole smallest tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pricegrain import registry
from pricegrain.functions.text import STOP_WORDS, similarity
from pricegrain.operators import resolve
from pricegrain.sources.adapter import description, store, table


def test_fold_lines(spark, sf_dir):
    rows = registry.lines(spark, sf_dir).orderBy("fatura_id", "pos").collect()
    want = []
    for r in rows:
        text = "POUPANCA" if r["pos"] % 3 == 1 else "0,816 kg 1,70 EUR/kg" if r["pos"] % 5 == 2 else r["descricao_original"]
        above = want[-1] if want and want[-1]["fatura_id"] == r["fatura_id"] else None
        if above and text == "POUPANCA":
            above["desconto_direto"] = (above["desconto_direto"] or 0.0) + abs(r["valor"] if r["valor"] is not None else r["desconto_direto"] or 0.0)
        elif above and " kg " in text:
            above["linha_peso"], above["valor"] = text, above["valor"] if r["valor"] is None else r["valor"]
        else:
            want.append({"fatura_id": r["fatura_id"], "pos": r["pos"], "descricao_original": text, "linha_peso": None, "valor": r["valor"], "desconto_direto": r["desconto_direto"]})
    found = [r.asDict() for r in registry.queries()["dobrar_linhas"](spark, sf_dir).collect()]
    key = lambda r: (r["fatura_id"], r["pos"])
    assert sorted(found, key=key) == sorted(want, key=key) and any(r["linha_peso"] for r in want)


def test_resolve(spark, sf_dir):
    s = store(spark, sf_dir)
    items = s.item.select("descricao_original", "sku_id").distinct().collect()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), description(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("texto")).join(s.sku_normalizado, "id").collect()
    used = {r["sku_id"] for r in items}
    products = [p for p in parts if p["id"] in used]
    alias: dict[str, int] = {}
    for r in items:
        if r["sku_id"] is not None:
            key = r["descricao_original"].lower()
            alias[key] = min(alias.get(key, r["sku_id"]), r["sku_id"])
    named = defaultdict(list)
    for p in parts:
        named[p["texto"].lower()].append((p["nome_canonico"].title(), p["marca"], p["categoria"], p["unidade_base"], p["formato_valor"]))
    words = lambda name: [w for w in re.sub(r"[^a-z0-9]+", " ", name.lower()).split() if w not in STOP_WORDS]

    def similar(a, b):
        x, y = words(a), words(b)
        if not x or not y:
            return 0.0
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        dice = 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y)))
        return max(dice, 0.95) if set(small) <= set(large) and len(set(small)) >= 2 and x[0] == y[0] else dice

    want = {}
    new = []  # products that earlier texts made: text, name, brand, unit, format
    decided = {}
    near = lambda x, y: (x is None and y is None) or (x is not None and y is not None and abs(float(x) - float(y)) <= 0.01)
    for text in sorted({r["descricao_original"] for r in items if r["sku_id"] is None}, key=str.lower):
        key = text.lower()
        name, brand, _, unit, pack = min(named[key])
        fits = [(0, p["id"], p["nome_canonico"], p["formato_valor"]) for p in products if p["marca"] == brand and p["unidade_base"] == unit]
        fits += [(1, k, n, f) for k, n, b, u, f in new if (b, u) == (brand, unit)]
        score, (kind, best) = min(((-similar(name, n), (k, i)) for k, i, n, f in fits if near(f, pack)), default=(0.0, (0, None)))
        same = min(((k, i) for k, i, n, _ in fits if words(n) == words(name)), default=None)
        if key in alias:
            want[text] = ("alias", alias[key], None)
            continue
        group = (name.lower(), brand, unit, pack)
        if group in decided:
            via, sku, by = decided[group]
            want[text] = ("match", None, by) if via == "novo" else (via, sku, by)
            continue
        chosen = (kind, best) if -score >= 0.85 else same
        if chosen:
            want[text] = ("match", chosen[1], None) if chosen[0] == 0 else ("match", None, chosen[1])
        else:
            want[text] = ("novo", None, key)
            new.append((key, name, brand, unit, pack))
        decided[group] = want[text]
    found = registry.queries()["resolver_sku"](spark, sf_dir).collect()
    assert {r["descricao_original"]: (r["via"], r["sku_id"], r["representante"]) for r in found} == want


def test_resolve_in_order(spark):
    """Random names, formats and verdicts, one text after another."""
    rng = random.Random(3)
    name = lambda: " ".join(rng.choices(["azeite", "virgem", "extra", "bio", "suave", "novo", "a1", "b2"], k=rng.randint(1, 5)))
    texts = [(f"t{i:03}", name(), rng.choice(["M", None]), rng.choice([None, 1.0, 1.0, 1.005, 2.0]), rng.choice([0.9, 0.9, 0.9, 0.3])) for i in range(120)]
    products = [(i, name(), rng.choice(["M", None]), rng.choice([None, 1.0])) for i in range(1, 9)]
    names = sorted({t[1] for t in texts} | {p[1] for p in products})
    verdicts = [(a, b, rng.random() < 0.6) for a in names for b in names if rng.random() < 0.5]
    yes = {(a, b) for a, b, v in verdicts if v}
    scores = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b"))).collect()
    score_of = {(a, b): s for a, b, s in scores}
    near = lambda x, y: x == y if x is None or y is None else abs(x - y) <= 0.01
    want, new, groups = {}, [], {}
    for text, title, brand, pack, sure in texts:
        if sure < 0.6:
            want[text] = ("revisao", None, None)
            continue
        if (title, brand, pack) in groups:
            via, sku, by = groups[title, brand, pack]
            want[text] = ("match", None, by) if via == "novo" else (via, sku, by)
            continue
        fits = [((0, i), n, f) for i, n, b, f in products if b == brand] + [((1, k), n, f) for k, n, b, f in new if b == brand]
        score, best, other = min(((-score_of[title, n], who, n) for who, n, f in fits if near(f, pack)), default=(0.0, None, None))
        chosen, via = (best if -score >= 0.85 else min((who for who, n, _ in fits if n == title), default=None)), "match"
        if chosen is None and -score >= 0.6 and (title, other) in yes:
            chosen, via = best, "match-llm"
        if chosen:
            want[text] = (via, chosen[1], None) if chosen[0] == 0 else (via, None, chosen[1])
        else:
            want[text] = ("novo", None, text)
            new.append((text, title, brand, pack))
        groups[title, brand, pack] = want[text]
    canonical = spark.createDataFrame([(t, n, b, "C", "un", f, c) for t, n, b, f, c in texts], "descricao_original string, nome_canonico string, marca string, categoria string, unidade_base string, formato_valor double, confianca double")
    known = spark.createDataFrame([(i, n, b, "un", f) for i, n, b, f in products], "id long, nome_canonico string, marca string, unidade_base string, formato_valor double")
    aliases = spark.createDataFrame([], "descricao_original string, sku_id long, origem string")
    judged = spark.createDataFrame(verdicts, "nome_a string, nome_b string, mesmo boolean")
    out = resolve.resolve(canonical.select("descricao_original"), aliases, canonical, known, judged).persist()
    found = {r["descricao_original"]: (r["via"], r["sku_id"], r["representante"]) for r in out.collect()}
    assert found == want and {v[0] for v in found.values()} == {"novo", "match", "match-llm", "revisao"} and any(v[0] == "match-llm" and v[2] for v in found.values())
    items = spark.createDataFrame([(i, t[0], None if i % 3 else 77, i % 5 == 0) for i, t in enumerate(texts)], "id long, descricao_original string, sku_id long, is_non_product boolean")
    all_products, all_aliases, lines = resolve.add_resolved(out, known, aliases, items)
    ids = {k: 9 + i for i, k in enumerate(t for t, v in want.items() if v[0] == "novo")}
    final = {t: sku or ids.get(by) for t, (_, sku, by) in want.items()}
    assert {r["id"] for r in all_products.collect()} == {*range(1, 9), *ids.values()}
    assert {r["descricao_original"]: r["sku_id"] for r in all_aliases.collect()} == {t: s for t, s in final.items() if s}
    assert all(r["sku_id"] == (77 if r["id"] % 3 == 0 else None if r["is_non_product"] else final[r["descricao_original"]]) for r in lines.collect())
