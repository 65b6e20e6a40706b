"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's mergeable frequent-items sketch) names the digests that may be frequent. Their exact
count and survivor are computed with partial aggregation, and these verified winners, at most WINNERS rows, are
broadcast, so rows with a frequent digest are settled where they are read. All other digests have few rows each and
go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Digests that may be broadcast: any digest with more than 1/WINNERS of the rows is among them.
WINNERS = 1024
#: Counters of a summary; a digest is missed only with fewer rows than 1/(0.75 * COUNTERS) of all.
COUNTERS = 2048
#: Summaries that are merged side by side before the last merge.
MERGES = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256"))


def frequent(keys: DataFrame, column: str) -> DataFrame:
    """Up to WINNERS candidate values of a long column, as a frame with that column."""
    part = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES))).agg(F.expr(f"approx_top_k_accumulate({column}, {COUNTERS})").alias("summary"))
    # By a constant key, since Spark can't combine the summary of a partition without rows.
    top = part.groupBy(F.lit("all")).agg(F.expr("approx_top_k_combine(summary)").alias("summary"))
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {WINNERS})")).alias("top")).select(F.col("top.item").alias(column))


def heavy_hitters(seen: DataFrame, id_col: str) -> DataFrame:
    """text_sha256, keep_id, group_size of at most WINNERS digests of rows (id, text_sha256, digest_key), with their exact counts."""
    candidates = F.broadcast(frequent(seen, "digest_key"))
    counted = seen.join(candidates, "digest_key", "left_semi").groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return F.broadcast(counted.orderBy(F.desc("group_size"), "text_sha256").limit(WINNERS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; a null text is the empty text. Of equal texts the
    largest id stays. Repeated rows (equal text and equal id) share one decision. A null id never wins against a real
    one; a group in which every id is null has a null keep_id and keeps its rows. Other columns are not read. An empty
    table gives no rows.
    """
    seen = digests(docs, id_col, text_col).withColumn("digest_key", F.xxhash64("text_sha256")).persist()
    winners = heavy_hitters(seen, id_col)
    heavy = seen.join(winners, "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = seen.join(winners, "text_sha256", "left_anti").select("*", F.max(id_col).over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    kept = F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull())
    names = [id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256"]
    return heavy.select(*names).unionByName(light.select(*names))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of equal texts (as in exact_dedup): that of the largest id, nulls last.

    Of rows with that id the one whose text comes first in byte order stays, so repeated rows and rows without an id leave
    one too. Rows of heavy hitters that don't stay go where they are read; the others are shuffled once, by their digest.
    """
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`") for c in names), F.sha2(ascii_lower(F.col(text_col)), 256).alias("__digest"))
    winners = heavy_hitters(digests(docs, id_col, text_col).withColumn("digest_key", F.xxhash64("text_sha256")), id_col)
    winners = winners.select(F.col("text_sha256").alias("__digest"), F.col("keep_id").alias("__keep"))
    rest = own.join(winners, "__digest", "left").filter(F.col("__keep").isNull() | (F.col("__keep") == F.col(id_col)))
    first = Window.partitionBy("__digest").orderBy(F.desc_nulls_last(id_col), F.asc_nulls_last(text_col))
    return rest.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").select(*(F.col(f"`{c}`") for c in names))
