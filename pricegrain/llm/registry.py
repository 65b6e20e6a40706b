"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language_id, toxicity
from .ann import nearest
from .common import UPPER, remainder, table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .packing import pack
from .ppm import ppm_scores
from .sentence_pieces import digests
from .simhash import simhash_groups
from .source_audit import source_divergence
from .suffix_dedup import suffix_dedup


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    found = ppm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    documents = table(spark, sf_dir, "documents")
    found = language_id.language_id(documents, language_id.fit(documents, allowed=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_html_text, op4_ppm_scores, op5_language_id, op6_simhash_near_dedup, op7_nearest_neighbours, op8_sentence_pieces, op9_suffix_array_dedup, op10_exact_dedup, op11_decontamination, op12_source_divergence, op13_filter_audit)}


def lowered_words(pattern: str) -> str:
    """SQL of the matches of a pattern in a text of which only A-Z are lower-cased."""
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{pattern}')"


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
            WINDOW w AS (PARTITION BY n)""",
        "op11_decontamination": f"""
            WITH d AS (SELECT doc_id, {lowered_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
            i AS (SELECT CAST(item_id AS VARCHAR) AS item, {lowered_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
            windows AS (SELECT DISTINCT item, least(len(w), 10) AS l, w[k : k + least(len(w), 10) - 1] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
            grams AS (SELECT doc_id, k, l, w[k : k + l - 1] AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)),
            hits AS (SELECT doc_id, k, l, item FROM grams JOIN windows USING (l, g)),
            covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM hits) GROUP BY 1),
            listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
        "op12_source_divergence": f"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {lowered_words('[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
            t AS (SELECT r, lang, source, unnest(w) AS term FROM d), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3), g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT g.lang, g.source, k.term, count(t.term) AS n, any_value(k.n) AS m FROM g JOIN kept k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
            s AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p, 1 + (1000000000::HUGEINT * (m + 1)) // (sum(m) OVER w + count(*) OVER w) AS q FROM c WINDOW w AS (PARTITION BY lang, source)),
            sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL),
            parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200""",
        "op13_filter_audit": """
            WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
            f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails, good, toxic FROM d LEFT JOIN l USING (doc_id)),
            m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL), x AS (SELECT unnest(range(1, 6)) AS i),
            o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
            went AS (SELECT *, list_position(list_transform(o, lambda i: fails[i]), TRUE) AS gone FROM m, o), steps AS (SELECT *, unnest(range(1, 6)) AS step FROM went),
            s AS (SELECT part, list_aggregate(list_transform(o, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS i, sum(n) FILTER (gone IS NULL OR gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (fails[o[step]] AND gone < step) AS redundant,
            sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails, sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost FROM steps GROUP BY part, o, step)
            SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
            CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, i), 0) AS BIGINT) AS shapley FROM s""",
    }
