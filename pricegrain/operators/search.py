"""Search by posting lists: texts by the letters they hold, names by their spelling.

Lists are kept for distinct texts and words, not for lines, and are written sorted by their grams, so a search reads the
row groups of its own grams. What the lists name is a candidate only: LIKE or the edit distance decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BARE, MARKED, contains_pattern, fold, fold_text, normal_name, tokens

#: Letters of a gram of texts and of a gram of words.
TEXT_GRAM, WORD_GRAM = 3, 2
#: The list of all texts, or all words, for terms that have no gram.
ALL = ""
#: What fold() makes of single letters.
LETTERS = {ord(c): BARE[i] if i < len(BARE) else None for i, c in enumerate(MARKED)}


@dataclass(frozen=True)
class SearchIndex:
    """textos: grama, texto. grafias: grama, vezes, palavra, tamanho. nomes: palavra, id, nome_canonico."""

    textos: DataFrame
    grafias: DataFrame
    nomes: DataFrame


def grams(x: Column, n: int) -> Column:
    """Every run of n letters, repeats included."""
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def text_lists(texts: DataFrame) -> DataFrame:
    """grama, texto of the distinct texts of a one-column frame; nulls have no list."""
    distinct = texts.toDF("texto").filter(F.col("texto").isNotNull()).distinct()
    return distinct.select(F.explode(F.array_distinct(F.concat(F.array(F.lit(ALL)), grams(fold(F.col("texto")), TEXT_GRAM)))).alias("grama"), "texto")


def name_words(products: DataFrame) -> DataFrame:
    """palavra, id, nome_canonico: a name without its spaces, and each of its tokens."""
    whole = F.replace(normal_name(F.col("nome_canonico")), F.lit(" "), F.lit(""))
    words = products.select("id", "nome_canonico", F.explode(F.array_distinct(F.concat(F.array(whole), tokens(F.col("nome_canonico"))))).alias("palavra"))
    return words.filter("palavra != ''").select("palavra", "id", "nome_canonico")


def word_lists(words: DataFrame) -> DataFrame:
    """grama, vezes, palavra, tamanho of the distinct words."""
    distinct = words.select("palavra").distinct()
    found = grams(F.col("palavra"), WORD_GRAM)
    counted = F.transform(F.array_distinct(found), lambda g: F.struct(g.alias("grama"), F.size(F.filter(found, lambda x: x == g)).alias("vezes")))
    rows = F.concat(F.array(F.struct(F.lit(ALL).alias("grama"), F.lit(0).alias("vezes"))), counted)
    return distinct.select(F.explode(rows).alias("g"), "palavra").select("g.grama", "g.vezes", "palavra", F.length("palavra").alias("tamanho"))


def search_index(items: DataFrame, products: DataFrame) -> SearchIndex:
    """The index over the descriptions of lines and the names of products."""
    words = name_words(products)
    return SearchIndex(text_lists(items.select("descricao_original")), word_lists(words), words)


def write_index(index: SearchIndex, folder: str) -> None:
    """Writes the lists in ranges of grams, the list of a frequent gram over several files."""
    for name, by in (("textos", ("grama", "texto")), ("grafias", ("grama", "tamanho", "palavra")), ("nomes", ("palavra", "id"))):
        getattr(index, name).repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("textos", "grafias", "nomes")))


def new_text_lists(lists: DataFrame, items: DataFrame) -> DataFrame:
    """The rows to append to `lists` for lines that came later: those of texts without a list."""
    known = lists.filter(F.col("grama") == ALL).select(F.col("texto").alias("descricao_original"))
    return text_lists(items.select("descricao_original").distinct().join(known, "descricao_original", "left_anti"))


def term_grams(term: str) -> list[str]:
    """The grams that every text holds in which LIKE finds the term; wildcards in it divide it."""
    runs = re.split(r"[%_\\]+", fold_text(term))
    return sorted({run[i : i + TEXT_GRAM] for run in runs for i in range(len(run) - TEXT_GRAM + 1)}) or [ALL]


def texts_with(lists: DataFrame, terms: list[str]) -> DataFrame:
    """texto: the distinct texts that contain any of the terms, whatever its case and accents."""

    def one(term: str) -> DataFrame:
        wanted = term_grams(term)
        listed = lists.filter(F.col("grama").isin(*wanted))
        if len(wanted) > 1:
            listed = listed.groupBy("texto").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        return listed.select("texto").filter(fold(F.col("texto")).like(contains_pattern(term)))

    found = reduce(DataFrame.unionByName, map(one, terms))
    return found.distinct() if len(terms) > 1 else found


def edits(longer: Column, least: float) -> Column:
    """Edits at most between words of which the longer has so many letters, for a ratio of `least` or more."""
    return F.floor(longer * (1.0 - least) + 1e-9).cast("int")


def words_like(lists: DataFrame, term: str, least: float) -> DataFrame:
    """palavra, score of the words whose character ratio with the term (a normal name without spaces) is `least` or more; least > 0.

    An edit changes WORD_GRAM grams at most, so words of n letters, the longer, and d edits share n + 1 - WORD_GRAM -
    WORD_GRAM * d grams or more, and their lengths differ by d at most: no such word is lost. Where that bound is 0 or
    less, as for very short words, all words of the length are candidates.
    """
    if not term:
        return lists.select("palavra", F.lit(0.0).alias("score")).limit(0)
    mine = Counter(term[i : i + WORD_GRAM] for i in range(len(term) - WORD_GRAM + 1))
    limit = lambda n: int(n * (1.0 - least) + 1e-9)
    lengths = [n for n in range(1, int(len(term) / least + 1e-9) + 1) if abs(n - len(term)) <= limit(max(n, len(term)))]
    loose = [n for n in lengths if max(n, len(term)) + 1 - WORD_GRAM - WORD_GRAM * limit(max(n, len(term))) <= 0]
    near = lists.filter(F.col("tamanho").between(min(lengths), max(lengths)))
    wanted = F.col("grama").isin(*mine) if mine else F.lit(False)
    if loose:
        wanted = wanted | (F.col("grama") == ALL) & F.col("tamanho").isin(*loose)
    longer = F.greatest(F.col("tamanho"), F.lit(len(term)))
    times = F.coalesce(F.create_map(*(F.lit(x) for pair in mine.items() for x in pair))[F.col("grama")], F.lit(0)) if mine else F.lit(0)
    shared = near.filter(wanted).groupBy("palavra", "tamanho").agg(F.sum(F.least("vezes", times)).alias("comuns"))
    shared = shared.filter(F.col("comuns") >= longer + 1 - WORD_GRAM - WORD_GRAM * edits(longer, least))
    return shared.select("palavra", (1.0 - F.levenshtein(F.col("palavra"), F.lit(term)) / longer).alias("score")).filter(F.col("score") >= least)


def names_like(index: SearchIndex, term: str, least: float) -> DataFrame:
    """id, nome_canonico, score of the products whose name, or a token of it, is spelled like the term."""
    word = re.sub(r"[^a-z0-9]", "", str(term).lower().translate(LETTERS))
    alike = words_like(index.grafias, word, least)
    return index.nomes.join(alike, "palavra").groupBy("id", "nome_canonico").agg(F.max("score").alias("score"))
