"""The corpus pipeline: quality rules, near copies, benchmark passages, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept. All but the last return the columns of documents; the mixture repeats a
document as often as it is taken, so later stages see repeated rows.

Defined cases: a null or empty text fails the quality rules; of rows with one
doc_id, or none, those with different texts are different documents and equal
ones are copies; ties go to the smallest doc_id, nulls last; a very long text is
worked on whole in every stage; other columns may have any name and are kept; on
an empty table every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from tidemark.llm.common import documents, materialize, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

# Sampling, packing and template matching are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written before the next reads them, in place of those of the stage before that."""
    docs = documents(spark, sf_dir)
    paths = [new_path(spark, "stage") for _ in range(2)]
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}", paths[k % 2])
    return docs
