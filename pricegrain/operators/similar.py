"""Pairs of names that are alike, without meetings of all names that share a frequent word.

Names of a similarity of `least` or more share at least a certain part of their words, so they share one of their rarest
ones, whatever the rest is; names within longer ones share their first word and any other. Only these meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity_of, tokens


def with_meetings(names: DataFrame, seen: DataFrame, least: float, contains: str, within: str) -> DataFrame:
    """grupo, nome, lista and the keys at which a name meets those of the other side."""
    words = names.select("grupo", "nome", "lista", F.explode(F.array_distinct("lista")).alias("palavra")).join(seen, ["grupo", "palavra"])
    rows = words.groupBy("grupo", "nome").agg(F.any_value("lista").alias("lista"), F.array_sort(F.collect_list(F.struct("vezes", "palavra"))).alias("ordem"))  # the words of one name
    rows = rows.withColumn("ordem", F.transform("ordem", lambda x: x["palavra"]))
    n = F.size("ordem")
    shared = F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")
    first = F.get("lista", F.lit(0))
    others = F.filter("ordem", lambda x: x != first)
    pair = lambda kind: lambda x: F.concat_ws(" ", F.lit(kind), first, x)
    rare = F.transform(F.slice("ordem", 1, n - shared + 1), lambda x: F.concat(F.lit("p "), x))
    return rows.select("grupo", "nome", "lista", F.concat(rare, F.transform(others, pair(contains)), F.transform(F.slice(others, 1, 1), pair(within))).alias("chaves"))


def similar_names(left: DataFrame, right: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """grupo, nome_a, nome_b, score: names of `left` and `right` (grupo, nome) of one group and a similarity of `least` (up to 0.95) or more.

    ordered: only pairs with nome_a < nome_b, for names among themselves. Names without a word, and null groups, have no pairs.
    """
    distinct = lambda rows: rows.filter("grupo is not null").select("grupo", "nome").distinct().withColumn("lista", tokens(F.col("nome")))
    a, b = distinct(left), distinct(right)
    both = a if ordered else a.unionByName(b).distinct()
    seen = both.select("grupo", F.explode(F.array_distinct("lista")).alias("palavra")).groupBy("grupo", "palavra").agg(F.count(F.lit(1)).alias("vezes"))
    a = with_meetings(a, seen, least, "c", "d").select("*", F.explode("chaves").alias("encontro")).alias("a")
    b = with_meetings(b, seen, least, "d", "c").select("*", F.explode("chaves").alias("encontro")).alias("b")
    met: Column = (F.col("a.grupo") == F.col("b.grupo")) & (F.col("a.encontro") == F.col("b.encontro"))
    if ordered:
        met = met & (F.col("a.nome") < F.col("b.nome"))
    once = F.array_min(F.array_intersect("a.chaves", "b.chaves")) == F.col("a.encontro")
    pairs = a.join(b, met).filter(once).select(F.col("a.grupo").alias("grupo"), F.col("a.nome").alias("nome_a"), F.col("b.nome").alias("nome_b"), similarity_of(F.col("a.lista"), F.col("b.lista")).alias("score"))
    return pairs.filter(F.col("score") >= least)
