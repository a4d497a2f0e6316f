"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliolith.llm import decontaminate, mixing, neardup, pii, quality
from foliolith.llm.util import Stage, load, remove, shared_dir, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return neardup.dedup(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.remove_hits(spark, docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced."""
    return pii.sanitise(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, globally shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL can't express the approximate candidate search, the components and the disclosure model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written and read again, and
    what made it is removed."""
    docs = load(spark, sf_dir, "documents")
    root, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        made = len(Stage.roots)
        out, path = stage(spark, docs, sf_dir), f"{root}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        sweep(spark, made)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
