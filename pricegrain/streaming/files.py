"""Uploaded files as they come: each content is extracted once, whatever names and times it is sent under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.extractions import extracted
from ..sources.tables import file_kind

FILE = "path string, modificationTime timestamp, length long, content binary"


def files_arriving(spark: SparkSession, folder: str, files_per_batch: int = 100, most_bytes: int = 12 << 20) -> DataFrame:
    """Files as they come into a folder: path, length, content, tipo, digest. Larger ones are left out, as are empty ones.

    A batch holds at most files_per_batch * most_bytes of content.
    """
    files = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = files.filter((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return files.select("path", "length", "content", file_kind(F.col("path")).alias("tipo"), F.sha2("content", 256).alias("digest"))


def first_files(files: DataFrame) -> DataFrame:
    """One file of each content; the digests of all that came are state, 64 bytes for each, and contents aren't."""
    return files.dropDuplicates(["digest"])


def extract_arriving(files: DataFrame, step: Callable[[bytes, str], str], target: str, checkpoint: str, tries: int = 2) -> StreamingQuery:
    """Runs the extraction step on first_files() and writes path, digest, extracao_json, extracao to `target`, a folder lote=<n> for each batch.

    A batch that failed is extracted anew and takes the place of what it left, so no file counts twice. The query stops when
    all files are read; started anew with its checkpoint it knows what was sent before.
    """

    def write(batch: DataFrame, number: int) -> None:
        extracted(batch, step, tries, ("path", "digest")).write.mode("overwrite").parquet(f"{target.rstrip('/')}/lote={number}")

    return first_files(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
