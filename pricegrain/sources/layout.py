"""Receipts and lines laid out by month and receipt, so that the star is joined where its rows lie."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Store

#: Files that a month's receipts and its lines are cut into, by the receipt's id. A month of a history of 100 TB over 100 months then lies in files of 4 GB.
BUCKETS = 256


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def lay_out(store: Store, name: str, folder: str | None = None, buckets: int = BUCKETS) -> None:
    """Writes the tables <name>_fatura and <name>_item: partitioned by the receipt's month (mes), cut into `buckets` by the receipt's id and sorted by it.

    Lines without a receipt and receipts without a date have no month; they are read when no period is asked for. Rows are
    shuffled by bucket once, so each task writes one bucket's file of each month. With `folder` the files lie there, else in
    the warehouse.
    """
    dated = store.fatura.withColumn("mes", month(F.col("data_compra")))
    months = dated.groupBy("id").agg(F.min("mes").alias("mes")).withColumnRenamed("id", "fatura_id")
    for table, rows, key in (("fatura", dated, "id"), ("item", store.item.join(months, "fatura_id", "left"), "fatura_id")):
        writer = rows.repartition(buckets, key).write.mode("overwrite").partitionBy("mes").bucketBy(buckets, key).sortBy(key).format("parquet")
        if folder:
            writer = writer.option("path", f"{folder.rstrip('/')}/{table}")
        writer.saveAsTable(f"{name}_{table}")


def laid_out(spark: SparkSession, name: str, rest: Store, start: str | None = None, end: str | None = None) -> Store:
    """`rest` with the receipts and lines of lay_out(); of a period (days, both included) only the months that it touches are read.

    Both tables are pruned by month before they meet, and meet without a shuffle: bucket n of one holds the receipts of
    bucket n of the other.
    """

    def read(table: str) -> DataFrame:
        rows = spark.table(f"{name}_{table}")
        if start:
            rows = rows.filter(F.col("mes") >= start[:7])
        if end:
            rows = rows.filter(F.col("mes") <= end[:7])
        return rows.drop("mes")

    return replace(rest, fatura=read("fatura"), item=read("item"))
