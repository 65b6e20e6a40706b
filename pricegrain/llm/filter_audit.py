"""What five quality filters remove in every order, what they share, and each one's Shapley value.

A document's failures are five bits, so the documents of a part are 32 counts. They give the part's removal polynomial: the
expected number of removed documents if filter i is used with probability x_i, multilinear in x. At a corner of the cube it
is the number that a set of filters removes; its partial derivatives, integrated along the diagonal, are Shapley values.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters' letters; filter i fails where bit i of a mask is set, and the last one is the repeat of an earlier text.
FILTERS = "ABCDE"
REPEATED = 1 << (len(FILTERS) - 1)
SPACES = " \t\n\x0b\x0c\r"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask(texts: DataFrame) -> Column:
    """Bits of the filters A to D over the columns `text`, `words` (none is empty, but for those of an empty text)."""
    n, distinct = (F.when(F.col("text_trimmed") == "", 0).otherwise(F.size(w)).cast("long") for w in (F.col("words"), F.array_distinct("words")))
    capitals, length = F.regexp_count("text", F.lit("[A-Z]")).cast("long"), F.length("text").cast("long")
    fails = n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * length, F.col("text").rlike(r"[#$%&*|]")
    return sum((c.cast("int") * (1 << i) for i, c in enumerate(fails[1:], 1)), fails[0].cast("int"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, good, toxic, n: numbers of documents by part, failures and labels.

    Rows are counted by text before they meet, so copies are no hot key: of the rows of one digest there is one for each
    part and kind of label. The rows with the smallest id of a text pass the last filter, and those without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit(SPACES)).alias("text_trimmed"))
    texts = texts.withColumn("words", F.split("text_trimmed", r"[\x20\x09-\x0D]+"))
    rows = texts.select("id", "part", mask(texts).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("k"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), F.lit(0).alias("salt")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # Rows without an id meet no label, wherever they are dealt to.
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.hash("digest")).otherwise(0)).join(marks, ["id", "salt"], "left")
    by = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k")))
    kinds = rows.groupBy(*by).agg(F.sum("k").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("k"))), F.lit(0)).alias("without"))
    earliest = F.min("first.id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("passing", F.col("without") + F.when(F.col("first.id") == earliest, F.col("first.k")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(REPEATED).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    return kinds.select("part", "good", "toxic", both.alias("b")).groupBy("part", "b.mask", "good", "toxic").agg(F.sum("b.n").alias("n"))


def polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients, by the set of variables as bits, of the sum over masks m of counts[m] * (1 - the product over i in m of (1 - x_i))."""
    size = 1 << len(FILTERS)
    # Of the product, the set t of variables has the sign of its size in every mask that holds t.
    return [0] + [(1 if t.bit_count() % 2 else -1) * sum(n for m, n in counts.items() if m & t == t) for t in range(1, size)]


def corner(coefficients: list[int], used: int) -> int:
    """The polynomial where the variables in `used` are 1 and the others 0: how many documents those filters remove."""
    return sum(a for t, a in enumerate(coefficients) if t & used == t)


def shapley(coefficients: list[int], bit: int) -> Fraction:
    """The integral over s from 0 to 1 of the derivative by one variable where all variables are s."""
    # The derivative of x^t by a variable of t is s^(|t| - 1) there, whose integral is 1 / |t|.
    return sum((Fraction(a, t.bit_count()) for t, a in enumerate(coefficients) if t & bit), Fraction(0))


def audit(part: str, counts: list) -> Iterator[tuple]:
    """The rows of one part, from its counts (mask, n, good, toxic)."""
    every, good, toxic = (polynomial({c["mask"]: c[k] for c in counts}) for k in ("n", "good", "toxic"))
    total, full = sum(c["n"] for c in counts), (1 << len(FILTERS)) - 1
    values = [int(shapley(every, 1 << i) * factorial(len(FILTERS))) for i in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        used = 0
        for step, i in enumerate(order, 1):
            after = used | 1 << i
            removed = corner(every, after) - corner(every, used)
            lost = (corner(p, after) - corner(p, used) for p in (good, toxic))
            unique = corner(every, full) - corner(every, full ^ 1 << i)
            yield (part, "".join(FILTERS[j] for j in order), step, total - corner(every, after), removed, corner(every, 1 << i) - removed, unique, *lost, values[i])
            used = after


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: AUDIT.

    A: under 200 words; B: less than half of the words distinct; C: capitals over two per cent; D: one of the characters
    # $ % & * |; E: the text of a smaller id, in any part. Null texts and parts are empty; an empty text has no words, so A
    fails and B and C don't. Rows without an id never fail E, nor do rows that share the smallest id of their text. A
    document is good or toxic if any of its labels says so (labels: the id column, quality, toxic); null labels say nothing,
    and labels without a document or an id are left out. Other columns aren't read. No documents, no rows.
    """
    counts = judged(docs, labels, id_col, text_col, part_col)
    n_if = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    masks = counts.groupBy("part", "mask").agg(F.sum("n").alias("total"), n_if("good"), n_if("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", F.col("total").alias("n"), "good", "toxic")).alias("counts"))  # 32 at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in AUDIT.split(", ")]
        for batch in batches:
            for part, found in zip(batch["part"], batch["counts"], strict=True):
                yield pd.DataFrame(audit(part, found), columns=names)

    return parts.mapInPandas(run, AUDIT)
