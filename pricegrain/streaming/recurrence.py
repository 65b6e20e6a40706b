"""Recurring products of every day's last weeks, of a stream of lines or of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import fold
from ..operators.star import named_products, product_lines, with_receipts
from ..sources.tables import Store

DAYS = 60


def bought(store: Store) -> DataFrame:
    """Lines that count for recurrence: chave, nome, categoria, fatura_id, data_compra, item_id, preco_liquido."""
    name = F.coalesce("nome_simplificado", "nome_canonico", "descricao_original").alias("nome")
    key = F.coalesce("chave_curta", fold(F.col("descricao_original"))).alias("chave")
    # Products first: lines that meet their receipts last lie by receipt, so trips are counted where they are.
    lines = with_receipts(store.item.filter(F.col("is_non_product") == F.lit(False)).join(named_products(store), "sku_id", "left"), store)
    return lines.filter(product_lines()).select(key, name, "categoria", "fatura_id", "data_compra", "item_id", "preco_liquido")


def recurring(lines: DataFrame, days: int = DAYS, late: str = "1 day", min_idas: int = 2) -> DataFrame:
    """hoje, chave and the columns of habitual_products(): for every day, products of several trips on it and the `days` before.

    lines: those of bought(). A stream's day is done, and its row appended, when lines of `late` after its end have come;
    lines that are later still don't count. Lines without a date count on no day. Days are those of a session in UTC, as session() makes it.
    State holds a row for each trip of open days, then one for each product and day, and only these, which no longer grow with
    the trips, are dealt to the days' windows. Months are bits of one number, so `days`
    may span 63 months.
    """
    day = F.window("quando", "1 day").alias("dia")
    paid = F.max(F.struct("data_compra", "item_id", "preco_liquido")).alias("ultimo")
    first, last = F.min("nome").alias("nome"), F.max("categoria").alias("categoria")
    timed = lines.withColumn("quando", F.col("data_compra").cast("timestamp"))
    trips = timed.withWatermark("quando", late).groupBy(day, "chave", "fatura_id").agg(first, last, F.count(F.lit(1)).alias("n"), F.sum("preco_liquido").alias("pago"), paid)
    of_day = trips.groupBy("dia", "chave").agg(first, last, F.count(F.lit(1)).alias("idas"), F.sum("n").alias("n"), F.sum("pago").alias("pago"), F.max("ultimo").alias("ultimo"))
    month = F.expr("shiftleft(1L, CAST((year(ultimo.data_compra) * 12 + month(ultimo.data_compra)) % 64 AS INT))")
    window = F.window("dia", f"{days + 1} days", "1 day").alias("janela")
    grouped = of_day.groupBy(window, "chave").agg(
        F.min("nome").alias("produto"),
        last,
        F.sum("idas").alias("idas"),
        F.bit_count(F.bit_or(month)).cast("long").alias("meses"),
        F.sum("n").alias("unidades"),
        F.round(F.sum("pago"), 2).alias("total"),
        F.max("ultimo")["preco_liquido"].alias("ultimo_preco"),
    )
    today = F.date_format(F.date_sub(F.to_date("janela.end"), 1), "yyyy-MM-dd").alias("hoje")
    return grouped.filter(F.col("idas") >= max(2, int(min_idas))).select(today, "chave", "produto", "categoria", "idas", "meses", "unidades", "total", "ultimo_preco")


def habitual_by_day(store: Store, days: int = DAYS, most: int = 40) -> DataFrame:
    """What habitual_lately() shows on each day: the `most` most frequent products, of equal ones the first by name."""
    rank = F.row_number().over(Window.partitionBy("hoje").orderBy(F.desc("idas"), F.desc("meses"), F.desc("unidades"), "produto", "chave"))
    return recurring(bought(store), days).withColumn("rn", rank).filter(F.col("rn") <= most).drop("rn", "chave")


def follow(lines: DataFrame, target: str, checkpoint: str, days: int = DAYS, late: str = "1 day") -> StreamingQuery:
    """Appends recurring() of a stream to `target`, each day once; stops when all that is there is read and goes on with its checkpoint."""
    return recurring(lines, days, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
