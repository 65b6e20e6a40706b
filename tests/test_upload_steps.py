"""What an upload no longer does: sort its lines for their ids, carry whole receipts through rounds, meet its lines twice by receipt and text."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F
from test_upload import catalog_of, names, receipt, uploads

from pricegrain.functions import units
from pricegrain.operators import dml, receipts, upload


def test_steps(spark, tmp_path, monkeypatch):
    orders, numbered = [], upload.with_ids
    monkeypatch.setattr(upload, "with_ids", lambda new, old, order, **more: orders.append(order) or numbered(new, old, order, **more))
    rows = [(f"k{i:02}", receipt(f"N{i}", float(i), [(f"LEITE {j} 1L", 1.0) for j in range(i % 4)] + [("POUPANCA", 0.5)] * (i % 2)), None, None) for i in range(12, 0, -1)]
    _, found = upload.ingest(catalog_of(spark, tmp_path), uploads(spark, rows), canonical=names)
    lines = [(r["fatura_id"], i["id"], i["descricao_original"]) for r in sorted(found.collect(), key=lambda r: r["fatura_id"]) for i in r["itens"] or ()]
    # A discount without a line above it stays, as the first line does.
    want = [(10 + i, t) for i in range(1, 13) for t in [f"LEITE {j} 1L" for j in range(i % 4)]]
    assert [(f, t) for f, _, t in lines] == want and [n for _, n, _ in lines] == list(range(8, 8 + len(want)))
    assert ["fatura_id", "pos"] not in orders and ["chave_envio"] in orders
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(fatura_id" in x and "descricao_original" in x.split("hashpartitioning")[1].split(")")[0] for x in plan.splitlines())


def test_rounds_carry_keys_only(spark, monkeypatch):
    kept, plain = [], dml.settled
    monkeypatch.setattr(dml, "settled", lambda frame: kept.append(frame.columns) or plain(frame))
    ddl = "id long, loja_id long, numero_fatura string, data_compra timestamp_ntz, total_impresso double, texto string"
    rng, day = random.Random(5), datetime(2024, 3, 5)
    rows = [(i, rng.randrange(3), rng.choice([None, "A", "b", "B ", "c", f"x{i}"]), day, rng.choice([None, 1.0, 2.0, 3.0 + i % 40]), "t") for i in range(90)]
    found = dml.new_receipts(spark.createDataFrame(rows[5:], ddl), spark.createDataFrame(rows[:5], ddl))
    seen, want = set(), []
    for i, s, n, _, total, _ in rows:
        own = ({(s, n.strip().lower())} if n else set()) | ({(s, total)} if total else set())
        if i < 5 or not own & seen:
            seen |= own
            want += [i] if i >= 5 else []
    assert sorted(r["id"] for r in found.collect()) == want and found.columns == [c.split()[0] for c in ddl.split(", ")]
    assert len(kept) >= 3 and all("texto" not in c for c in kept[1:])


def test_sums_before(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(5)) for i in rng.sample(range(1000), 300)]
    found = dml.with_ids(spark.createDataFrame(rows, "k long, n int"), spark.createDataFrame([(7,)], "id long"), ["k"], counted="n").collect()
    want, total = {}, 0
    for i, (k, n) in enumerate(sorted(rows)):
        want[k] = (8 + i, total)
        total += n
    assert {r["k"]: (r["id"], r["antes_n"]) for r in found} == want


def test_guards_lose_nothing(spark):
    """Where a pattern is found, so is what is looked for first."""
    rng = random.Random(4)
    parts = ("1", "12", "0,816", "1.250", " ", "  ", "x", "×", "X", "kg", "KGS", "K", "g", "Gr", "ml", "CL", "lt", "L", "un", "UN", "dz", "ovo", "Ovos", "meia", "dúzia", "DUZIA", "eur/kg", "€ / kg", "Poupança", "DESC.", "promoç", "PROMOC", "desconto", "leite", "p", "D", "", "0,816 kg 1,70 eur/kg", "0,816kg×2.5 € / KG", "0,81 x 1,7", "6x1,5l", "ovos 6")
    texts = [(" ".join(rng.choices(parts, k=rng.randint(0, 6))) if i % 2 else "".join(rng.choices(parts, k=rng.randint(0, 8))),) for i in range(6000)]
    rows = spark.createDataFrame(texts, "t string")
    t = F.col("t")
    packs = (units.WEIGHED, units.BARE_WEIGHED, units.MULTIPACK, units.SIMPLE, units.COUNTED, units.DOZENS, units.HALF_DOZEN, units.DOZEN, *units.EGGS)
    counts = rows.agg(
        *(F.count_if(t.rlike(p)).alias(f"p{i}") for i, p in enumerate(packs)), *(F.count_if(t.rlike(p) & ~t.rlike(units.ANY_PACK)).alias(f"lost{i}") for i, p in enumerate(packs)),
        *(F.count_if(t.rlike(p)).alias(f"w{i}") for i, p in enumerate((receipts.LOOSE, receipts.INLINE, receipts.DISCOUNT))),
        F.count_if((t.rlike(receipts.LOOSE) | t.rlike(receipts.INLINE)) & ~receipts.has_fraction(t)).alias("lost_weights"), F.count_if(t.rlike(receipts.DISCOUNT) != receipts.discounts(t)).alias("lost_discounts"),
    ).first().asDict()
    assert all(v == 0 if k.startswith("lost") else v > 0 for k, v in counts.items()), counts
