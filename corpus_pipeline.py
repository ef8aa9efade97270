"""Corpus pipeline: the tables of a folder through a quality classifier, exact, near and substring dedup, and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reliefspark.llm.common import materialize
from reliefspark.llm.exact_dedup import drop_exact_duplicates
from reliefspark.llm.packing import pack_documents
from reliefspark.llm.quality import keep_quality
from reliefspark.llm.simhash import drop_near_duplicates, drop_simhash_duplicates
from reliefspark.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, as op5; of what stays, texts that share four fifths of their shingles though their fingerprints differ by more."""
    return drop_near_duplicates(materialize(drop_simhash_duplicates(docs), "simhash"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", substring), ("best-fit packing", packing)]

#: A trained classifier, connected components and best-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
