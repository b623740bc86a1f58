"""The corpus pipeline: rules, near-duplicates, benchmark passages, secrets, and the mix of sources, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import decontaminate, jaccard_join, mixing, quality_rules, secrets
from quarrygraph.llm.common import materialize


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with the copy's number."""
    return mixing.mix(spark, docs)


STAGES = [
    ("quality_rules", quality_rules.filter_quality),
    ("jaccard_join", jaccard_join.keep_one),
    ("decontaminate", decontaminate.drop_contaminated),
    ("secrets", secrets.redact_secrets),
    ("mix_sources", mix_sources),
]

#: Expectation-maximisation, tries and tagging have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
