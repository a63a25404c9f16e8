"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Every stage works on all that the one before it kept; the result is a row for each packed piece. In all
stages null texts are empty (and fail the quality rules), repeated rows and repeated or null ids are
documents of their own, and an empty table stays empty. All but the last keep every column of their input,
whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlloom.llm import common, decontaminate, packing, rules, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and their language's perplexity band let pass."""
    return rules.apply(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.deduplicate(docs)


def template_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of every document."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, simhash_near_dedup, template_decontamination, secret_scan, best_fit_packing)]
#: Language-model scores, fingerprints and tokens have no SQL form: tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = common.made()
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.release(spark, before, keep=1)  # what the stage wrote on its way, and the stage before it
    return docs
