"""From receipt texts to products: aliases, canonical names, similar products, new products.

What a language model decides comes in as tables: canonical names of texts, and verdicts on pairs of similar names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, normal_name
from ..functions.units import pack_format
from .components import components
from .dml import insert_ignore, settled, with_ids
from .similar import similar_names

SURE, POSSIBLE, CONFIDENT = 0.85, 0.6, 0.6

#: Names that are linked are decided one after another in a task while their links are at most so many.
TASK_LINKS = 100_000


def close_format(a: Column, b: Column) -> Column:
    """Both unknown, or within 0.01."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= 0.01, F.lit(False))


def group_of() -> Column:
    """Brand, which may be missing, and unit, as one key; null without a unit."""
    return F.concat(F.coalesce(F.concat(F.lit("m"), fold(F.col("marca"))), F.lit("-")), F.lit("\u0000"), F.col("unidade_base"))


def links(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """no, candidato, nome, score, igual: what each wanted name may stand for, of its brand and unit.

    wanted: no, grupo, nome, formato; offered: candidato, grupo, nome, formato. Either the score is POSSIBLE or more and
    the formats are close, or the names are equal (igual); of equal names whose formats differ the score is 0.
    """
    w = wanted.select("no", "grupo", F.col("nome").alias("nome_a"), F.col("formato").alias("fa"))
    o = offered.select("candidato", "grupo", F.col("nome").alias("nome_b"), F.col("formato").alias("fb"))
    near = close_format(F.col("fa"), F.col("fb"))
    alike = similar_names(wanted, offered, POSSIBLE).join(w, ["grupo", "nome_a"]).join(o, ["grupo", "nome_b"]).filter(near)
    letters = lambda rows, name: rows.withColumn("letras", normal_name(F.col(name)))
    same = letters(w, "nome_a").join(letters(o, "nome_b"), ["grupo", "letras"])
    met = alike.select("no", "candidato", F.col("nome_b").alias("nome"), "score", F.lit(False).alias("igual"))
    met = met.unionByName(same.select("no", "candidato", F.col("nome_b").alias("nome"), F.lit(0.0).alias("score"), F.lit(True).alias("igual")))
    return met.groupBy("no", "candidato").agg(F.any_value("nome").alias("nome"), F.max("score").alias("score"), F.max("igual").alias("igual"))


def best_of(found: DataFrame) -> DataFrame:
    """no, melhor (candidato, nome, score), igual: the most similar of the links(), the first on a tie, and the first of an equal name."""
    best = F.min_by(F.struct("candidato", "nome", "score"), F.struct((-F.col("score")).alias("s"), "candidato"))
    return found.groupBy("no").agg(best.alias("melhor"), F.min(F.when(F.col("igual"), F.col("candidato"))).alias("igual"))


def decided(nodes: DataFrame, of_products: DataFrame, of_new: DataFrame, yes: DataFrame) -> DataFrame:
    """no, nome, via, sku_id, novo_no of names by their links to products and to names that are new products; products go first on a tie."""
    old = best_of(of_products).select("no", F.col("melhor").alias("p"), F.col("igual").alias("p_igual"))
    new = best_of(of_new).select("no", F.col("melhor").alias("t"), F.col("igual").alias("t_igual"))
    rows = nodes.select("no", "nome").join(old, "no", "left").join(new, "no", "left")
    p, t = (F.coalesce(F.col(f"{c}.score"), F.lit(0.0)) for c in "pt")
    rows = rows.withColumn("nova", t > p).withColumn("score", F.greatest(p, t)).withColumn("nome_b", F.when(t > p, F.col("t.nome")).otherwise(F.col("p.nome")))
    rows = rows.join(yes, (fold(F.col("nome")) == F.col("ja")) & (fold(F.col("nome_b")) == F.col("jb")), "left")
    sure, same = F.col("score") >= SURE, F.col("p_igual").isNotNull() | F.col("t_igual").isNotNull()
    via = F.when(sure | same, "match").when((F.col("score") >= POSSIBLE) & F.coalesce("sim", F.lit(False)), "match-llm").otherwise("novo")
    by_score = sure | (via == "match-llm")
    sku = F.when(by_score, F.when(~F.col("nova"), F.col("p.candidato"))).when(via == "match", F.col("p_igual"))
    other = F.when(by_score, F.when(F.col("nova"), F.col("t.candidato"))).when((via == "match") & F.col("p_igual").isNull(), F.col("t_igual")).when(via == "novo", F.col("no"))
    return rows.select("no", "nome", via.alias("via"), sku.alias("sku_id"), other.alias("novo_no"))


def said_yes(rows: DataFrame, yes: DataFrame) -> DataFrame:
    """Rows (de, nome, ...) with `sim`: whether the verdict on the two names is yes."""
    return rows.join(yes, (fold(F.col("de")) == F.col("ja")) & (fold(F.col("nome")) == F.col("jb")), "left").withColumn("sim", F.coalesce("sim", F.lit(False))).drop("ja", "jb")


def made_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """no of the names of one component that become products.

    rows: the names (no, hesita, and score and sim of their best product), and their links to earlier names (no, candidato, forte, score, sim).
    """
    links: dict = {}
    named = rows["candidato"].isna()
    for no, candidate, strong, score, sim in rows.loc[~named, ["no", "candidato", "forte", "score", "sim"]].itertuples(index=False):
        links.setdefault(no, []).append((candidate, strong, score, sim))
    made: dict = {}
    for no, doubts, score, sim in sorted(rows.loc[named, ["no", "hesita", "score", "sim"]].itertuples(index=False, name=None)):
        met = [x for x in links.get(no, ()) if x[0] in made]
        if any(strong for _, strong, _, _ in met):
            continue
        if doubts:
            if met and (best := min(met, key=lambda x: (-x[2], x[0])))[2] > score:  # products go first on a tie
                score, sim = best[2], best[3]
            if score >= POSSIBLE and sim:
                continue
        made[no] = True
    return pd.DataFrame({"no": list(made)}, dtype=object)


def new_in_components(open_: DataFrame, hindering: DataFrame, of_products: DataFrame, yes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the open names those that become products, decided by component in a task each; and the names that this decided.

    Components of more than TASK_LINKS links, and names without links, are left to rounds.
    """
    groups = components(hindering.select(F.col("no").alias("a"), F.col("candidato").alias("b")))
    linked = hindering.join(groups, "no")
    small = linked.groupBy("grupo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= TASK_LINKS).select("grupo")
    names = settled(open_.join(groups.join(small, "grupo"), "no"))
    best = best_of(of_products.join(names.filter("hesita"), "no", "left_semi")).select("no", F.col("melhor.nome").alias("melhor"), F.col("melhor.score").alias("score"))
    nodes = said_yes(names.join(best, "no", "left").withColumnsRenamed({"nome": "de", "melhor": "nome"}), yes)
    nodes = nodes.select("grupo", "no", F.lit(None).cast("string").alias("candidato"), F.coalesce("hesita", F.lit(False)).alias("hesita"), F.lit(False).alias("forte"), F.coalesce("score", F.lit(0.0)).alias("score"), "sim")
    edges = said_yes(linked.join(names.select("no", F.col("nome").alias("de")), "no"), yes)
    edges = edges.select("grupo", "no", "candidato", F.lit(False).alias("hesita"), ((F.col("score") >= SURE) | F.col("igual")).alias("forte"), "score", "sim")
    made = nodes.unionByName(edges).groupBy("grupo").applyInPandas(made_in_order, "no string")
    return settled(made), names.select("no")


def new_names(nodes: DataFrame, of_products: DataFrame, between: DataFrame, yes: DataFrame) -> DataFrame:
    """no of the names that become products, when names are decided in the order of `no` and each sees the products that earlier ones made.

    between: links() to earlier names. Names that are linked, over any number of others, are decided in a task of their own.
    What has too many links for that is decided in rounds: in each, names without open earlier ones are decided, and those go
    that are sure to stand for a product just made. Names that no other name resembles, mostly all, are decided in the first.
    """
    strong = (F.col("score") >= SURE) | F.col("igual")
    judged = lambda found: found.filter(~strong).join(nodes.select("no", F.col("nome").alias("de")), "no").join(yes, (fold(F.col("de")) == F.col("ja")) & (fold(F.col("nome")) == F.col("jb")))
    # Possible products matter to those names only of which a verdict says yes.
    hesitant = judged(of_products).select("no").unionByName(judged(between).select("no")).distinct()
    hindering = between.filter(strong).unionByName(between.filter(~strong).join(hesitant, "no", "left_semi"))
    open_ = settled(nodes.select("no", "nome").join(of_products.filter(strong), "no", "left_anti").join(hesitant.withColumn("hesita", F.lit(True)), "no", "left"))
    hindering = settled(hindering.join(open_, "no", "left_semi").join(open_.select(F.col("no").alias("candidato")), "candidato", "left_semi"))
    made, decided_now = new_in_components(open_, hindering, of_products, yes)
    open_ = settled(open_.join(decided_now, "no", "left_anti"))
    hindering = settled(hindering.join(decided_now, "no", "left_anti"))
    while not open_.isEmpty():
        waits = hindering.join(open_.select(F.col("no").alias("candidato")), "candidato", "left_semi").select("no")
        ready = open_.join(waits, "no", "left_anti")
        to_made = hindering.join(made.select(F.col("no").alias("candidato")), "candidato", "left_semi")
        doubtful = ready.filter("hesita")
        fresh = decided(doubtful, of_products.join(doubtful, "no", "left_semi"), to_made.join(doubtful, "no", "left_semi"), yes).filter("via = 'novo'").select("no")
        fresh = settled(ready.filter("hesita is null").select("no").unionByName(fresh))
        gone = hindering.filter(strong).join(fresh.select(F.col("no").alias("candidato")), "candidato", "left_semi").select("no")
        made = made.unionByName(fresh)
        open_ = settled(open_.join(ready.select("no"), "no", "left_anti").join(gone, "no", "left_anti"))
    return made


def with_formats(canonical: DataFrame) -> DataFrame:
    """Canonical names with the format that their text tells, none where it is weighed, unless they bring formato_valor; and the text's unit where they have none."""
    pack = canonical.withColumn("embalagem", pack_format(F.trim("descricao_original")))
    if "formato_valor" not in canonical.columns:
        pack = pack.withColumn("formato_valor", F.when(F.col("embalagem.quantidade_kg").isNull(), F.col("embalagem.formato_valor")).cast("decimal(10,3)"))
    return pack.withColumn("unidade_base", F.coalesce(F.nullif("unidade_base", F.lit("")), "embalagem.unidade_base")).drop("embalagem")


def resolve(texts: DataFrame, aliases: DataFrame, canonical: DataFrame, products: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row per distinct text (case, accents and outer blanks apart): chave, descricao_original, via, sku_id, the canonical fields, representante.

    via: alias (known text), revisao (no canonical name of confidence 0.6 or more), match (a product of score 0.85 or more,
    or of the same name), match-llm (score 0.6 or more and a yes among `verdicts` (nome_a, nome_b, mesmo)), novo.
    Texts are decided in order, and each sees the products of earlier ones: a text that stands for a new product has no
    sku_id but the text that made it (representante; its own for novo). Texts of one canonical name, brand, unit and
    format are decided together with the first of them. add_resolved() gives new products their ids.
    texts: descricao_original; canonical: descricao_original, nome_canonico, marca, categoria, unidade_base, confianca. The
    format comes from the text (with_formats()), or from canonical's formato_valor if it has one.
    """
    spark = texts.sparkSession
    canonical = with_formats(canonical)
    distinct = texts.filter(fold(F.col("descricao_original")) != "").groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min("descricao_original").alias("descricao_original"))
    known = aliases.groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min("sku_id").alias("de_alias"))
    named = canonical.groupBy(fold(F.col("descricao_original")).alias("chave")).agg(F.min(F.struct("nome_canonico", "marca", "categoria", "unidade_base", "formato_valor", F.coalesce("confianca", F.lit(0.5)).alias("confianca"))).alias("c"))
    rows = distinct.join(known, "chave", "left").join(named, "chave", "left").select("chave", "descricao_original", "de_alias", "c.*")
    sure = F.coalesce(F.col("nome_canonico").isNotNull() & (F.col("confianca") >= CONFIDENT), F.lit(False))
    rows = settled(rows.withColumns({"sabido": sure, "grupo": group_of(), "dobrado": fold(F.col("nome_canonico"))}))
    node = ["grupo", "dobrado", "formato_valor"]
    asks = rows.filter("sabido and de_alias is null")
    nodes = asks.groupBy(*node).agg(F.min("chave").alias("no"), F.min_by("nome_canonico", "chave").alias("nome")).withColumnRenamed("formato_valor", "formato")
    nodes = settled(nodes)
    offered = products.groupBy(group_of().alias("grupo"), F.col("nome_canonico").alias("nome"), F.col("formato_valor").alias("formato")).agg(F.min("id").alias("candidato"))
    yes = spark.createDataFrame([], "nome_a string, nome_b string, mesmo boolean") if verdicts is None else verdicts
    yes = yes.filter("mesmo").select(fold(F.col("nome_a")).alias("ja"), fold(F.col("nome_b")).alias("jb"), F.lit(True).alias("sim")).distinct()
    of_products = settled(links(nodes, offered))
    between = settled(links(nodes, nodes.withColumnRenamed("no", "candidato")).filter("candidato < no"))
    made = settled(new_names(nodes, of_products, between, yes))
    done = decided(nodes, of_products, between.join(made.select(F.col("no").alias("candidato")), "candidato", "left_semi"), yes)
    done = nodes.select("grupo", "dobrado", "formato", "no").join(done.drop("nome"), "no").withColumnRenamed("formato", "formato_valor")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in node]
    told = asks.alias("r").join(done.alias("d"), on).select("r.chave", "d.no", F.col("d.via").alias("v"), "d.sku_id", "d.novo_no")
    out = rows.join(told, "chave", "left")
    first = (F.col("v") == "novo") & (F.col("no") != F.col("chave"))  # texts after the one that makes the product stand for it
    via = F.when(F.col("de_alias").isNotNull(), "alias").when(~F.col("sabido"), "revisao").when(first, "match").otherwise(F.col("v"))
    return out.select("chave", "descricao_original", via.alias("via"), F.coalesce("de_alias", "sku_id").alias("sku_id"), "nome_canonico", "marca", "categoria", "unidade_base", "formato_valor", F.col("novo_no").alias("representante"))


def resolved_texts(resolved: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products after resolve(), and the texts that have one: chave, descricao_original, achado (its id)."""
    made = with_ids(resolved.filter("via = 'novo'"), products, ["chave"])
    all_products = products.unionByName(made.select("id", *(c for c in products.columns if c != "id" and c in made.columns)), allowMissingColumns=True)
    of_text = resolved.join(made.select(F.col("chave").alias("representante"), F.col("id").alias("novo_id")), "representante", "left")
    return all_products, settled(of_text.select("chave", "descricao_original", F.coalesce("sku_id", "novo_id").alias("achado")).filter("achado is not null"))


def with_aliases(aliases: DataFrame, of_text: DataFrame) -> DataFrame:
    """Aliases of all resolved_texts(); those that are there already stay as they are."""
    fresh = of_text.select("descricao_original", F.col("achado").alias("sku_id"), F.lit("llm").alias("origem")).select(*(c for c in ("descricao_original", "sku_id", "origem") if c in aliases.columns))
    return insert_ignore(aliases, fresh, ["descricao_original"])


def given_products(items: DataFrame, of_text: DataFrame, *more: str) -> DataFrame:
    """Lines without a product given that of their text, but for lines that are no products; and its columns `more`, null for other lines."""
    lines = items.withColumn("chave", fold(F.col("descricao_original"))).join(of_text.select("chave", "achado", *more), "chave", "left")
    own = F.col("sku_id").isNull() & (F.col("is_non_product") == F.lit(False))
    lines = lines.withColumns({"sku_id": F.when(own, F.col("achado")).otherwise(F.col("sku_id")), **{c: F.when(own, F.col(c)) for c in more}})
    return lines.select(*items.columns, *more)


def add_resolved(resolved: DataFrame, products: DataFrame, aliases: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, aliases and lines after resolve(): new products, an alias of every text with a product, and lines without one given theirs.

    Lines that are no products stay without; aliases that are there already stay as they are.
    """
    all_products, of_text = resolved_texts(resolved, products)
    return all_products, with_aliases(aliases, of_text), given_products(items, of_text)


def counters(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("via").agg(F.count(F.lit(1)).alias("n"))
