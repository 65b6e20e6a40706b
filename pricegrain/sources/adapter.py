"""The driver's tables in the roles of a purchase history, so that every query can run on them.

Customers are stores, orders receipts, line items receipt lines and parts products. The id of a line is a struct of the
columns that together are unique; it is used for order and never shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Store

LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def description(key, name, size):  # noqa: ANN001, ANN201
    """A receipt's text for a part: with a weight, a multipack, a count or nothing."""
    plain = F.upper(name)
    how = F.when(key % 4 == 0, F.concat(F.lit(" "), (size * 10).cast("string"), F.lit("G"))).when(key % 4 == 1, F.concat(F.lit(" "), (size % 6 + 2).cast("string"), F.lit("X"), size.cast("string"), F.lit("CL")))
    return F.concat(plain, how.when(key % 4 == 2, F.concat(F.lit(" "), size.cast("string"), F.lit("UN"))).otherwise(""))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cadeia"), F.col("c_name").alias("nome"), F.col("n_name").alias("localizacao"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, "kg").when(F.col("p_size") % 3 == 1, "L").otherwise("un")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("nome_canonico"),
        F.when(F.col("p_size") <= 25, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("nome_simplificado"),
        F.col("p_brand").alias("marca"),
        F.col("p_type").alias("categoria"),
        unit.alias("unidade_base"),
        (F.col("p_size") / 10).cast("decimal(10,3)").alias("formato_valor"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("loja_id"),
        F.col("o_orderdate").alias("data_compra"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_impresso"),
        (F.col("o_orderstatus") == "P").alias("needs_review"),
        (F.col("o_orderkey") % 7 - 3).cast("decimal(10,2)").alias("discrepancia"),
        F.col("o_orderpriority").alias("origem_captura"),
        F.when(F.col("o_orderkey") % 2 == 0, "vlm").otherwise("ocr_llm").alias("metodo_extracao"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("modelo-"), (F.col("o_orderkey") % 5).cast("string"))).alias("modelo"),
        F.col("o_orderdate").alias("criado_em"),
    )


def items(spark: SparkSession, sf_dir: str, described: bool = True) -> DataFrame:
    """Lines of known parts; without their descriptions, lines of any part, for queries that meet the products themselves."""
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey")) if described else rows
    return rows.select(
        F.struct(*LINE_ID).alias("id"),
        F.col("l_orderkey").alias("fatura_id"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey")).alias("sku_id"),
        *([description(F.col("l_partkey"), F.col("p_name"), F.col("p_size")).alias("descricao_original")] if described else []),
        F.col("l_quantity").cast("decimal(10,3)").alias("quantidade"),
        F.when(F.col("l_quantity") < 10, price.cast("decimal(14,4)")).alias("preco_unitario"),
        F.round(price * (1 - discount), 2).cast("decimal(12,2)").alias("preco_liquido"),
        F.round(price * discount, 2).cast("decimal(12,2)").alias("desconto_direto"),
        F.when(F.col("l_quantity") < 48, F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000.0 + 0.5) / 10000.0).alias("preco_por_base"),
        (F.col("l_returnflag") == "R").alias("is_clearance"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("is_non_product"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two verdicts for two receipts in three."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("fatura_id"))
    first = o.select((F.col("fatura_id") * 2).alias("id"), "fatura_id", F.when(F.col("fatura_id") % 4 == 0, "erro").otherwise("ok").alias("veredicto"))
    again = o.filter("fatura_id % 5 = 0").select((F.col("fatura_id") * 2 + 1).alias("id"), "fatura_id", F.lit("ok").alias("veredicto"))
    return first.unionByName(again)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("contexto"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("modelo"), F.col("value").cast("decimal(12,8)").alias("custo"), F.col("ts").alias("criado_em")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("utilizador"), F.col("role").alias("papel"), F.col("text").alias("conteudo"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said in conversations, as facts about them."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("utilizador"), F.col("text").alias("fato"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(loja=stores(spark, sf_dir), sku_normalizado=products(spark, sf_dir), fatura=receipts(spark, sf_dir), item=items(spark, sf_dir), mensagem=messages(spark, sf_dir), perfil=facts(spark, sf_dir), custo_chamada=calls(spark, sf_dir), revisao=reviews(spark, sf_dir))
