"""Receipts that arrive in batches, with a restart between them: the same as all at once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricegrain.operators import dml
from pricegrain.sources.tables import complete
from pricegrain.streaming import arrivals

DDL = "id long, loja_id long, numero_fatura string, dia int, total_impresso double"


def bills(spark, rows):
    frame = spark.createDataFrame(rows, DDL)
    when = F.when(F.col("dia").isNotNull(), F.expr("timestamp_ntz'2024-03-01 10:00:00' + make_dt_interval(dia)"))
    return complete(frame.withColumn("data_compra", when), "fatura")


def test_restart(spark, tmp_path):
    rng = random.Random(11)
    draw = lambda i: (i, rng.choice([None, 1, 1, 2, 3]), rng.choice([None, *"ABCDEFGHIJ"]), rng.choice([None, *range(6)]), rng.choice([None, 1.0, 2.0, 3.0]))
    old, new = [draw(i) for i in range(15)], [draw(i) for i in range(15, 135)]
    existing = dml.new_receipts(bills(spark, old), bills(spark, []))
    existing.write.parquet(str(tmp_path / "old"))
    existing = spark.read.parquet(str(tmp_path / "old"))
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    seen = []
    for half in (new[:60], new[60:]):  # the second half comes when the query has ended, and it is started anew
        for k in range(0, 60, 20):
            bills(spark, half[k : k + 20]).coalesce(1).write.mode("append").parquet(folder)
        query = arrivals.ingest(arrivals.arriving(spark, folder, 1), existing, target, checkpoint)
        query.awaitTermination()
        seen += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    found = sorted(r["id"] for r in spark.read.parquet(target).collect())
    want = sorted(r["id"] for r in dml.new_receipts(bills(spark, new), existing).collect())
    assert found == want and 0 < len(want) < 100
    assert sum(seen) == 120  # each receipt is read once, and what is stored isn't read again
    row = spark.read.parquet(target).filter("data_compra is not null").first()
    assert row["total_impresso"] is None or row["total_impresso"] in (1, 2, 3)
    arrivals.ingest(arrivals.arriving(spark, folder, 1), existing, target, checkpoint).awaitTermination()  # nothing new
    assert spark.read.parquet(target).count() == len(want)
    assert spark.conf.get(arrivals.PROVIDER, None) != arrivals.STORE
