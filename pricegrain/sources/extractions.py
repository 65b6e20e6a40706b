"""Receipts as JSON from an extraction step: lenient parsing, lines, and the steps that are injected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXTRACTION


def json_part(text: Column) -> Column:
    """What lies from the first { to the last }, without code fences; null if there is none. A text that is nothing else isn't searched."""
    part = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(part)


def parse(frame: DataFrame, column: str = "extracao_json") -> DataFrame:
    """Adds `extracao`, null where the text is no receipt: not JSON, or without a list `itens`."""
    found = F.from_json(json_part(F.col(column)), EXTRACTION, {"mode": "PERMISSIVE"})
    return frame.withColumn("extracao", F.when(found["itens"].isNotNull(), found))


def readable_only(frame: DataFrame, column: str = "extracao_json") -> DataFrame:
    """The rows of `frame` whose text is a receipt, with `extracao` instead of it.

    The text is parsed once: as a generator's rows, where a filter behind parse() would parse it again for itself and for each field.
    """
    found = F.filter(F.array(F.from_json(json_part(F.col(column)), EXTRACTION, {"mode": "PERMISSIVE"})), lambda x: x["itens"].isNotNull())
    return frame.select(*(c for c in frame.columns if c != column), F.explode(found).alias("extracao"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, extracao_json, extracao."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("extracao_json"))
    return parse(files)


def lines(frame: DataFrame, key: str) -> DataFrame:
    """The receipts' lines in order: key, pos (from 0), and the line's fields."""
    return frame.select(key, F.posexplode("extracao.itens").alias("pos", "linha")).select(key, "pos", "linha.*")


def readable(text: str | None) -> bool:
    """Whether parse() would read a receipt from the text."""
    try:
        return isinstance(json.loads(text[text.index("{") : text.rindex("}") + 1]).get("itens"), list)
    except (AttributeError, TypeError, ValueError):
        return False


def extracted(files: DataFrame, step: Callable[[bytes, str], str], tries: int = 2, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Runs an injected step (content, kind) -> JSON text over the files of read_files(), in batches on the executors.

    The columns `keep` of the files stay beside extracao_json and extracao. A step whose answer is no receipt is asked again, `tries` times in all; its last answer stays.
    """

    def ask(content: bytes, kind: str) -> str:
        for _ in range(tries):
            if readable(said := step(content, kind)):
                break
        return said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(keep)].assign(extracao_json=[ask(c, k) for c, k in zip(batch["content"], batch["tipo"], strict=True)])

    kinds = dict(files.dtypes)
    return parse(files.select(*keep, "content", "tipo").mapInPandas(run, f"{', '.join(f'{c} {kinds[c]}' for c in keep)}, extracao_json string"))
