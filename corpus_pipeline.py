"""A corpus pipeline: toxic documents, copies, near copies and repeated passages go, and the rest is packed.

Each stage takes (spark, docs, sf_dir), with docs as the stage before it left them, and returns a DataFrame: the columns
of `documents`, and from the last stage the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from pricegrain.llm.common import remainder, small_batches, table, written
from pricegrain.llm.registry import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; rows held out of training in the operator's query are so here too."""
    small_batches(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), allowed=remainder(F.col("doc_id"), 3) != 1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that resemble each other, over shingles of five words, by 0.8 or more, the one with the smallest id."""
    return simhash.distinct_documents(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier too."""
    return suffix_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", drop_repeats), ("best_fit_packing", pack)]

#: SQL can't express the classifier, the fingerprints and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each leaves is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
