"""How the sources of a language differ in their words, in relational operators and whole numbers only.

Terms of documents are exploded and counted by language, source and term. Terms of enough documents of a language are kept;
every group of a language and a source gets a row for each of them, so that missing ones count as zero. Groups meet on
language and term, their divergences are summed by pair, and windows rank them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: What lies between terms, of which only A-Z are lower-cased: matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ are what is left.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
#: A share of one, and the counts up to which UNIT times the next one is within 64 bits.
UNIT, SMALL = 1_000_000_000, 9_000_000_000


def lowered(text: Column) -> Column:
    """ascii_lower(); a text of ASCII alone, which has as many bytes as characters, goes by the plain function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, documents: how often a term occurs in a group, and in how many of its documents."""
    terms = docs.select("lang", "source", F.sort_array(F.split(lowered(F.col("text")), BETWEEN)).alias("terms"))
    # Equal terms are neighbours, so a document's term is one row, with its count, before rows are grouped.
    starts = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = F.transform("starts", lambda i, k: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("terms")) - i).alias("times")))
    rows = terms.withColumn("starts", starts).select("lang", "source", F.inline(runs)).filter("term != ''")
    return rows.groupBy("lang", "source", "term").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("documents"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), in decimals where UNIT times the count is over 64 bits."""
    small = F.call_function("div", (count + 1) * F.lit(UNIT), total + terms)
    whole = lambda c: c.cast("decimal(20,0)")
    large = F.call_function("div", (whole(count) + 1) * F.lit(UNIT), whole(total) + whole(terms))
    return F.lit(1) + F.when(count < SMALL, small).otherwise(large)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q). Shares are at most UNIT + 1, so the square fits in 64 bits, and so does a group's sum, whose shares are UNIT and one a term together."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    part `pair`: each other source of the language, with the summed divergence of the group's shares from that source's;
    part `term`: the group's terms whose share is above the language's, with their divergence, the `most_terms` largest.
    Ranks start at 1, larger values first, ties in byte order of the item. Null texts, languages and sources are empty. A
    group without kept terms has its pairs, with shares as of zero counts; without any kept term in the language they are 0.
    Repeated rows count as documents of their own. Other columns aren't read. No documents, no rows.
    """
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    # A term's row holds a count for each source of its language at most; every two of them are a pair in the result.
    by_term = term_counts(rows).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    none = F.lit(0).cast("long")
    kept = written(by_term.filter(F.col("documents") >= least_documents).drop("documents"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total"))))
    # Dealt by language and term before groups are crossed in, so that the rows of every group needn't be shuffled to meet.
    dense = kept.repartition("lang", "term").join(groups, "lang").withColumn("count", F.coalesce(F.try_element_at("counts", F.col("source")), none))
    dense = dense.select("lang", "term", "source", "count", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    p, q = F.col("a.p"), F.col("b.p")
    met = dense.select("lang", "term", "source", "p").alias("a").join(dense.select("lang", "term", "source", "p").alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    sums = met.groupBy("a.lang", F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(F.sum(divergence(p, q)).alias("xy"), F.sum(divergence(q, p)).alias("yx"))
    told = groups.select("lang", F.col("source").alias("x")).join(groups.select("lang", F.col("source").alias("y")), "lang").filter("x < y").join(sums, ["lang", "x", "y"], "left")
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.coalesce("xy", none).alias("value")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.coalesce("yx", none).alias("value"))))
    pairs = told.select("lang", both.alias("r")).select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "r.value")
    above = dense.filter((F.col("count") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(above.withColumn("rank", place).filter(F.col("rank") <= most_terms))
