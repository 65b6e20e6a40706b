"""Exact medians in bounded memory, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

#: Rows of a group that a buffer may hold, the cuts of a round, and the accuracy of the sketch that proposes them.
MOST, CUTS, ACCURACY = 10_000, 31, 10_000


def medians(rows: DataFrame, by: str, value: str, most: int = MOST) -> DataFrame:
    """by, mediana, n: the median of each group's values as doubles, and how many there are; null values and groups don't count.

    Groups of up to `most` rows are sorted in a buffer. In larger ones the middle value is selected: a sketch proposes
    cuts, the rows below and at each are counted exactly, and the range that holds the middle is cut again until its rows
    fit the buffer. A cut that is the middle ends the search, so ties cost no rounds. Groups and values are kept as a table
    first; each round reads that once and shuffles counts only, whatever joins the rows come from.
    """
    values = rows.select(F.col(by).alias("grupo"), F.col(value).cast("double").alias("valor")).filter("grupo IS NOT NULL AND valor IS NOT NULL")
    values = settled(values)
    large = settled(values.groupBy("grupo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    plain = lambda v: v.groupBy("grupo").agg(F.median("valor").alias("mediana"), F.count(F.lit(1)).alias("n"))
    if large.isEmpty():
        return plain(values).withColumnRenamed("grupo", by)
    rest = plain(values.join(large, "grupo", "left_anti"))
    return rest.unionByName(middles(values.join(large.select("grupo"), "grupo", "left_semi"), large, most)).withColumnRenamed("grupo", by)


def middles(values: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """grupo, mediana, n of the groups (grupo, n) by selection; for an even n the mean of the two middle values."""
    # alvo: the wanted row's place, from 0, among those strictly between de and ate (null: open), of which there are dentro.
    none = F.lit(None).cast("double")
    state = groups.select("grupo", "n", F.floor((F.col("n") - 1) / 2).cast("long").alias("alvo"), none.alias("de"), none.alias("ate"), F.col("n").alias("dentro"), none.alias("meio"))
    within = (F.col("de").isNull() | (F.col("valor") > F.col("de"))) & (F.col("ate").isNull() | (F.col("valor") < F.col("ate")))
    todo = F.col("meio").isNull() & (F.col("dentro") > most)
    while not (open_ := state.filter(todo)).isEmpty():
        inside = values.join(open_.select("grupo", "de", "ate"), "grupo").filter(within)
        cuts = inside.groupBy("grupo").agg(F.percentile_approx("valor", [k / (CUTS + 1) for k in range(1, CUTS + 1)], ACCURACY).alias("cortes"))
        cuts = settled(cuts.withColumn("cortes", F.array_sort(F.array_distinct("cortes"))))
        met = inside.join(cuts, "grupo")
        cut = lambda i: F.get("cortes", F.lit(i))
        counts = met.groupBy("grupo").agg(*(F.count_if(F.col("valor") < cut(i)).alias(f"a{i}") for i in range(CUTS)), *(F.count_if(F.col("valor") <= cut(i)).alias(f"b{i}") for i in range(CUTS)))
        counted = F.array(*(F.struct(cut(i).alias("corte"), F.col(f"a{i}").alias("abaixo"), F.col(f"b{i}").alias("ate")) for i in range(CUTS)))
        counts = counts.join(cuts, "grupo").select("grupo", F.slice(counted, F.lit(1), F.size("cortes")).alias("cortes"))
        joined = state.join(counts, "grupo", "left")
        below = F.filter("cortes", lambda x: x["abaixo"] <= F.col("alvo"))
        joined = joined.withColumn("antes", F.try_element_at(below, F.lit(-1))).withColumn("depois", F.get(F.filter("cortes", lambda x: x["abaixo"] > F.col("alvo")), F.lit(0)))
        found = F.col("antes").isNotNull() & (F.col("alvo") < F.col("antes.ate"))
        passed = F.coalesce("antes.ate", F.lit(0))
        state = settled(
            joined.select(
                "grupo",
                "n",
                (F.col("alvo") - passed).alias("alvo"),
                F.coalesce("antes.corte", "de").alias("de"),
                F.coalesce("depois.corte", "ate").alias("ate"),
                (F.coalesce("depois.abaixo", "dentro") - passed).alias("dentro"),
                F.when(found, F.col("antes.corte")).otherwise(F.col("meio")).alias("meio"),
            )
        )
    few = values.join(state.filter("meio IS NULL").select("grupo", "alvo", "de", "ate"), "grupo").filter(within)
    last = few.groupBy("grupo").agg(F.array_sort(F.collect_list("valor")).alias("valores"), F.any_value("alvo").alias("alvo"))  # `most` at the most
    last = last.select("grupo", F.get("valores", F.col("alvo").cast("int")).alias("ultimo"))
    lower = settled(state.join(last, "grupo", "left").select("grupo", "n", F.coalesce("meio", "ultimo").alias("meio")))
    after = values.join(lower, "grupo").groupBy("grupo", "n", "meio").agg(F.count_if(F.col("valor") <= F.col("meio")).alias("ate"), F.min(F.when(F.col("valor") > F.col("meio"), F.col("valor"))).alias("seguinte"))
    single = (F.col("n") % 2 == 1) | (F.col("ate") > F.col("n") / 2)
    return after.select("grupo", F.when(single, F.col("meio")).otherwise(0.5 * F.col("meio") + 0.5 * F.col("seguinte")).alias("mediana"), "n")
