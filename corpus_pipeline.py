"""Corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their language and source."""
    from photospark.llm.quality import keep_good

    return keep_good(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    from photospark.llm.jaccard import keep_one

    return keep_one(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages."""
    from photospark.llm.substrings import remove_repeats

    return remove_repeats(docs)


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    from photospark.llm.pii import mask

    return mask(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents in training sequences."""
    from photospark.llm.bestfit import pack

    return pack(docs)


STAGES = [
    ("quality rules", _quality), ("n-gram Jaccard join", _near), ("substring dedup", _passages), ("PII", _private), ("best-fit packing", _pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    from photospark.llm.scratch import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
