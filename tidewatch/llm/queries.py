"""The registered queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, bwt_repeats, decontam, hard_negatives, licenses, packing, quality_knn, rules_forest, secrets, simhash, url_filter, wrapper
from .common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a tokenizer file that a contract names, in the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, tau=3, least=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op4_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(spark)
    return url_filter.judge(table(spark, sf_dir, "pages"), weights, url_filter.held_out_cut(spark, weights))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_repeats.strip_repeats(table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_forest.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).drop("ids")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_url": op4_url,
    "op5_extract": op5_extract,
    "op6_repeats": op6_repeats,
    "op7_rules": op7_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_licenses": op9_licenses,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}

# op8's whole result has an SQL form. What the other methods add (model scores, hashed features, automata, tree alignment) has
# none; tests/llm holds those queries against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op8_decontaminate": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
    s AS (SELECT DISTINCT n FROM g),
    o AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
    f AS (SELECT r, k, o.n, item_id FROM o JOIN g ON o.p = g.p AND o.n = g.n),
    h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT r, k, n FROM f)) GROUP BY r),
    i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM f GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
    """,
    "op11_hard_negatives": r"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM e a, e c WHERE a.vec_id % 100 = 0 AND a.r <> c.r),
    p AS (SELECT r, id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
    n AS (SELECT anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}
