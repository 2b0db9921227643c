"""One query per operator with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, hard_negatives, jaccard_join, language_model, license_scan, line_dedup, mixing, pii, quality_rules, sharding, substring_dedup, token_alignment
from .common import documents


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", "dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op7_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir)).select("doc_id", *quality_rules.MEASURES, "kept")


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_recurrent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


#: Tokenizer files; the folder is on every machine of a cluster.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label)).drop("positive_rank")


def op12_pointer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.links(documents(spark, sf_dir), *TOKENIZERS)


def op13_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


QUERIES = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_line_templates": op2_line_templates,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_signature_trees": op4_jaccard_signature_trees,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_license_classifier": op6_license_classifier,
    "op7_pii_weak_supervision": op7_pii_weak_supervision,
    "op8_quality_divergence": op8_quality_divergence,
    "op9_vector_sharding": op9_vector_sharding,
    "op10_recurrent_scoring": op10_recurrent_scoring,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_pointer_alignment": op12_pointer_alignment,
    "op13_quotient_dedup": op13_quotient_dedup,
}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 g AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
 r AS (SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
 c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r),
 words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM words ANTI JOIN c USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op4_jaccard_signature_trees": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS p FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach(doc_id, least) AS (SELECT doc_id, doc_id FROM n UNION SELECT y, least FROM reach JOIN both_ ON x = reach.doc_id AND least < y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(least) AS least FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op11_angular_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_quotient_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
