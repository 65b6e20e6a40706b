"""Reading and writing the purchase tables: Parquet folders, JDBC, views, and snapshots that replace each other."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, schema


@dataclass(frozen=True)
class Store:
    """The relations that queries read. Any of them may be a table, a view or the result of another query."""

    loja: DataFrame
    sku_normalizado: DataFrame
    fatura: DataFrame
    item: DataFrame
    sku_alias: DataFrame | None = None
    mensagem: DataFrame | None = None
    perfil: DataFrame | None = None
    custo_chamada: DataFrame | None = None
    revisao: DataFrame | None = None
    #: A SearchIndex over the descriptions and names of these relations, if one is kept.
    indice: object | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: x for f in fields(self) if f.name in TABLES and (x := getattr(self, f.name)) is not None}


def complete(frame: DataFrame, name: str, *more: str) -> DataFrame:
    """The frame with the relation's columns and types, and the columns `more`; columns that it lacks are null."""
    return frame.select(*((F.col(f"`{f.name}`") if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)), *more)


def read_parquet(spark: SparkSession, folder: str) -> Store:
    """The relations in <folder>/<relation>."""
    return Store(**{name: spark.read.schema(schema(name)).parquet(f"{folder}/{name}") for name in TABLES})


def id_ranges(ids: DataFrame, partitions: int, name: str = "id") -> list[str]:
    """Conditions on id that cut its values into ranges of about as many rows each, nulls in the first; one that is true without rows.

    The cuts are quantiles of the ids, one number for each partition.
    """
    shares = [k / partitions for k in range(1, partitions)]
    found = ids.agg(F.percentile_approx("id", shares, 100 * partitions).alias("cortes")).first() if shares else None
    cuts = sorted(set((found and found["cortes"]) or []))
    if not cuts:
        return ["1 = 1"]
    return [f"{name} <= {cuts[0]} OR {name} IS NULL", *(f"{name} > {a} AND {name} <= {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{name} > {cuts[-1]}"]


def read_jdbc(spark: SparkSession, url: str, partitions: int = 8, **options: str) -> Store:
    """The relations of a database; those with an id are read in ranges of it that hold about as many rows each.

    The database is asked for the least and the greatest id, and its ids are read in even ranges between them to find
    their quantiles, so ids that crowd in one place don't end in one task.
    """

    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier("id")

    def read(table: str, **more) -> DataFrame:  # noqa: ANN003
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options, **more).load()

    def one(name: str) -> DataFrame:
        if not TABLES[name].startswith("id "):
            return complete(read(name), name)
        least, most = read(f"(SELECT MIN({column}) AS menor, MAX({column}) AS maior FROM {name}) limites").first()
        if least is None or partitions < 2 or least == most:
            return complete(read(name), name)
        ids = read(f"(SELECT {column} FROM {name}) ids", partitionColumn="id", lowerBound=least, upperBound=most + 1, numPartitions=partitions).toDF("id")
        properties = {k: str(v) for k, v in options.items()}
        return complete(spark.read.jdbc(url, name, predicates=id_ranges(ids, partitions, column), properties=properties), name)

    return Store(**{name: one(name) for name in TABLES})


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """The frame, computed once, as Parquet in shared_folder(): its lineage ends at those files, of which a plan reads only the columns it needs."""
    path = f"{shared_folder(frame.sparkSession)}/mesa-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def register(store: Store) -> None:
    """A temporary view of each relation, for spark.sql."""
    for name, frame in store.tables().items():
        frame.createOrReplaceTempView(name)


def write_snapshot(frame: DataFrame, folder: str, by: list[str] | None = None) -> str:
    """Writes a whole new version beside the older ones and returns its path; readers go on with theirs until they are given it."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = frame.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return path


def read_files(spark: SparkSession, path: str, most_bytes: int = 12 << 20) -> DataFrame:
    """Uploaded receipts or voice notes: path, length, content, and the kind that their names tell; larger files are left out."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes)
    return files.select("path", "length", "content", file_kind(F.col("path")).alias("tipo"))


def file_kind(path: Column, mime: Column | None = None) -> Column:
    """pdf, imagem, voz or outro, by the MIME type if that tells it, or by the name."""
    name, said = F.lower(path), F.lower(F.coalesce(F.lit(None).cast("string") if mime is None else mime, F.lit("")))
    kind = F.when(said.contains("pdf") | name.endswith(".pdf"), "pdf").when(said.startswith("image/"), "imagem").when(said.startswith("audio/"), "voz")
    return kind.when(name.rlike(r"\.(jpe?g|png|webp|heic)$"), "imagem").when(name.rlike(r"\.(webm|ogg|mp3|m4a|mp4|wav|flac)$"), "voz").otherwise("outro")


# Parts of audio MIME types and the formats they are sent as; the first that is found holds.
AUDIO = (("webm", "webm"), ("mp4", "m4a"), ("m4a", "m4a"), ("aac", "m4a"), ("mpeg", "mp3"), ("mp3", "mp3"), ("wav", "wav"), ("ogg", "ogg"))


def audio_format(mime: str) -> str:
    """The format name that a speech service wants for a MIME type; webm for any that isn't listed."""
    return next((name for part, name in AUDIO if part in (mime or "").lower()), "webm")
