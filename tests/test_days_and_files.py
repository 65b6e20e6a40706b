"""Recurrence by day, files as a stream, kept answers and laid-out tables."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricegrain.plans import purchases
from pricegrain.sources import layout
from pricegrain.sources.adapter import store
from pricegrain.sources.kept import Kept
from pricegrain.streaming import files, recurrence


def some(spark, sf_dir):
    """Receipts of one year's first months, with plain ids."""
    s = store(spark, sf_dir)
    bills = s.fatura.filter("data_compra >= '1997-01-01' and data_compra < '1997-06-01'")
    lines = s.item.filter("sku_id % 5 = 0").withColumn("id", F.xxhash64("id"))
    return replace(s, fatura=bills, item=lines)


COLUMNS = ["produto", "categoria", "idas", "meses", "unidades", "total", "ultimo_preco"]


def test_any_day(spark, sf_dir):
    s = some(spark, sf_dir)
    days = recurrence.habitual_by_day(s).cache()
    assert days.count() > 50
    for today in ("1997-01-20", "1997-03-31", "1997-04-01", "1997-06-15"):
        want = [tuple(r) for r in purchases.habitual_lately(s, today).select(*COLUMNS).collect()]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in days.filter(F.col("hoje") == today).select(*COLUMNS).collect()), today
    assert days.filter("hoje = '1997-03-31'").count() > 0


def test_days_of_a_stream(spark, sf_dir, tmp_path):
    """Lines come month by month, with a restart; days that are over are the table's."""
    lines = recurrence.bought(some(spark, sf_dir)).cache()
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for months in (("1997-01", "1997-02"), ("1997-03", "1997-04", "1997-05")):
        for m in months:
            lines.filter(F.date_format("data_compra", "yyyy-MM") == m).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(lines.schema).parquet(folder)
            recurrence.follow(stream, target, checkpoint).awaitTermination()
    found = sorted(map(str, spark.read.parquet(target).select("hoje", *COLUMNS).collect()))
    done = spark.read.parquet(target).agg(F.max("hoje")).first()[0]
    want = recurrence.recurring(lines).filter(F.col("hoje") <= done).select("hoje", *COLUMNS)
    assert found == sorted(map(str, want.collect())) and done >= "1997-05-20"


def test_files_sent_twice(spark, tmp_path):
    folder, target, checkpoint, log = (tmp_path / n for n in ("in", "out", "c", "log"))
    for p in (folder, log):
        p.mkdir()

    def step(content: bytes, kind: str) -> str:
        import uuid

        Path(log, uuid.uuid4().hex).write_bytes(content)
        return '{"itens": [{"descricao_original": "%s", "valor": 1}]}' % content.decode()

    def run():
        files.extract_arriving(files.files_arriving(spark, str(folder), 2), step, str(target), str(checkpoint)).awaitTermination()

    (folder / "a [1].pdf").write_bytes(b"um")
    (folder / "b.pdf").write_bytes(b"um")
    (folder / "c.jpg").write_bytes(b"dois")
    (folder / "empty.pdf").write_bytes(b"")
    run()
    (folder / "d.pdf").write_bytes(b"dois")
    (folder / "e.pdf").write_bytes(b"tres")
    run()
    run()
    assert sorted(p.read_bytes() for p in log.iterdir()) == [b"dois", b"tres", b"um"]
    rows = spark.read.parquet(str(target)).select("digest", F.col("extracao.itens")[0]["descricao_original"].alias("d")).collect()
    assert sorted(r["d"] for r in rows) == ["dois", "tres", "um"] and len({r["digest"] for r in rows}) == 3


def test_kept_answers(spark, tmp_path):
    kept, asked = Kept(spark, str(tmp_path)), []

    def compute(n):
        asked.append(n)
        return spark.range(n)

    def fails():
        return spark.range(1).select(F.raise_error(F.lit("offline")).alias("id"))

    assert kept.last("habituais") is None
    with pytest.raises(Exception, match="offline"):
        kept.renew("habituais", fails, 1, 500)
    assert kept.last("habituais") is None  # what failed is no answer
    assert kept.serve("habituais", lambda: compute(3), 1, 1000, 1_000).rows.count() == 3
    fresh = kept.serve("habituais", lambda: compute(4), 1, 1000, 2_000)
    assert (fresh.rows.count(), fresh.at, fresh.stale) == (3, 1_000, False)
    assert kept.serve("habituais", lambda: compute(4), 1, 1000, 2_001).stale  # too old
    assert kept.serve("habituais", lambda: compute(4), 2, 1000, 1_500).stale  # other inputs
    assert asked == [3]
    offline = kept.renew("habituais", fails, 2, 3_000)
    assert (offline.rows.count(), offline.at, offline.offline) == (3, 1_000, True)
    assert kept.renew("habituais", lambda: compute(5), 2, 4_000).rows.count() == 5
    now = kept.serve("habituais", lambda: compute(6), 2, 1000, 4_100)
    assert (now.rows.count(), now.version, now.stale, now.offline) == (5, 2, False, False)
    kept.clean("habituais", 1)
    assert len(list((tmp_path / "habituais").iterdir())) == 1 and kept.last("habituais").rows.count() == 5
    assert kept.keep("vazio", spark.range(0), 1, 1).rows.count() == 0 and kept.last("vazio").rows.isEmpty()


def test_laid_out_star(spark, sf_dir, tmp_path):
    s = store(spark, sf_dir)
    s = replace(s, fatura=s.fatura.withColumn("data_compra", F.when(F.col("id") % 50 != 0, F.col("data_compra"))))
    layout.lay_out(s, "historia", str(tmp_path), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        laid = layout.laid_out(spark, "historia", s, "1997-03-05", "1997-04-10")
        assert laid.fatura.count() == s.fatura.filter("data_compra >= '1997-03-01' and data_compra < '1997-05-01'").count()
        total = purchases.total_spent(laid, None, None, "1997-03-05", "1997-04-10")
        assert total.collect() == purchases.total_spent(s, None, None, "1997-03-05", "1997-04-10").collect()
        whole = layout.laid_out(spark, "historia", s)
        assert whole.fatura.count() == s.fatura.count() and whole.item.count() == s.item.count()
        facts = whole.item.withColumnRenamed("id", "item_id").join(whole.fatura.select(F.col("id").alias("fatura_id"), "data_compra"), "fatura_id").groupBy("fatura_id").agg(F.sum("preco_liquido"))
        plan = facts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(mes" in plan
        for name in ("loja", "sku_normalizado"):  # read from files, their sizes are known to be small
            getattr(s, name).write.parquet(str(tmp_path / name))
        small = {n: spark.read.parquet(str(tmp_path / n)) for n in ("loja", "sku_normalizado")}
        total = purchases.total_spent(replace(whole, **small), None, None, "1997-03-05", "1997-04-10")
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE historia_item")
        spark.sql("DROP TABLE historia_fatura")
