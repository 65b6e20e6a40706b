"""Receipts and model calls that arrive continuously, and spending over event time. An addition to the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.dml import receipt_keys
from ..schemas import schema

#: The state store that keyed state needs, and the setting that names it.
STORE, PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"

#: Groups for receipts without a key.
LOOSE = 64


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Receipts from Parquet files as they come into a folder."""
    return spark.readStream.schema(schema("fatura")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class FirstOfEquals(StatefulProcessor):
    """Of a store's receipts in the order of their ids, those that share no key with one that was kept before.

    The state is a map with the keys of the kept receipts; a row costs a lookup of its two keys, whatever the map holds.
    """

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("chaves", "chave string", "id long")

    def _keep(self, row: Row) -> None:
        for k in (row["kn"], row["kt"]):
            if k is not None:
                self.seen.updateValue((k,), (row["id"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: r["id"]):  # one store's receipts of one batch
            if not any(k is not None and self.seen.containsKey((k,)) for k in (row["kn"], row["kt"])):
                self._keep(row)
                yield Row(**{n: row[n] for n in self.names})

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        self._keep(initialState)

    def close(self) -> None:
        pass


def first_receipts(stream: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Of arriving receipts those that are no duplicates of `existing` or of one that has arrived and was kept; dml.new_receipts() as a stream.

    Receipts count as inserted batch by batch, and in the order of their ids within one. `existing` is read when the query
    starts for the first time and is state from then on. What shares no key with anything, for want of a store, or of a number
    and of a time or total, passes without state.
    """
    # Rows that share no key with anything are dealt apart from the stores, so that many of them are no hot group.
    has = F.col("kn").isNotNull() | F.col("kt").isNotNull()
    dealt = lambda rows: receipt_keys(rows).withColumn("parte", F.when(has, 0).otherwise(1 + F.pmod(F.hash("id"), F.lit(LOOSE))))
    old = None if existing is None else dealt(existing).filter(has).select("loja_id", "parte", "id", "kn", "kt").groupBy("loja_id", "parte")
    return dealt(stream).groupBy("loja_id", "parte").transformWithState(FirstOfEquals(stream.columns), stream.schema, "append", "none", old)


def ingest(stream: DataFrame, existing: DataFrame | None, target: str, checkpoint: str) -> StreamingQuery:
    """Appends first_receipts() to the Parquet folder `target`; stops when all files are read.

    A batch's work grows with the batch: neither `existing` nor `target` is read again. Started anew with its checkpoint, the
    query goes on where it ended, and a batch that failed is written once.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, STORE)
    try:
        return first_receipts(stream, existing).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it was started with
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def spending(lines: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Spending per chain and window of data_compra, of a stream or a table of lines (data_compra, cadeia, preco_liquido)."""
    timed = lines.withColumn("quando", F.col("data_compra").cast("timestamp")).withWatermark("quando", late)
    grouped = timed.groupBy(F.window("quando", window).alias("janela"), "cadeia").agg(F.sum("preco_liquido").alias("total"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("janela.start").alias("inicio"), "cadeia", "total", "n")


def call_rows(calls: DataFrame) -> DataFrame:
    """Rows of the cost log from model calls (contexto, modelo, usage, criado_em), of a stream or a table; calls without usage leave none.

    usage: prompt_tokens, completion_tokens, cost; what is missing counts as 0.
    """
    text = lambda c, most, default: F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)), 1, most).alias(c)
    number = lambda c, kind, name: F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast(kind).alias(name)
    rows = calls.filter("usage is not null")
    return rows.select(text("contexto", 30, "geral"), text("modelo", 60, ""), number("prompt_tokens", "int", "prompt_tokens"), number("completion_tokens", "int", "completion_tokens"), number("cost", "decimal(12,8)", "custo"), "criado_em")


def log_costs(calls: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the calls of a stream to the cost log in `target`, each once; stops when all that is there is read."""
    return call_rows(calls).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
