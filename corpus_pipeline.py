"""Corpus pipeline: quality, language, near duplicates, packing.

``STAGES`` are applied in order; each result is written as Parquet and read again as the next
one's documents. Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galley.llm import jaccard_join, language_ecoc, packing, quality_qda
from galley.llm.shared import pinned, prepared, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepared(spark)
    return quality_qda.kept(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and one clearly nearest language."""
    prepared(spark)
    return language_ecoc.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    prepared(spark)
    return jaccard_join.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    prepared(spark)
    return packing.digests(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pinned(docs, name)
    return docs


# Fitted classifiers, MinHash and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None
