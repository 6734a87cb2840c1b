"""A training corpus from documents: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs; so a stage begins by
deleting the tables that stages before it have left in the shared folder. All but the last return the columns of documents. SQL can't express the language
model, the signatures or the tokenizer, so there is no ORACLE_SQL; tests hold the stages' operators against brute-force versions.

Null and empty texts leave in the first stage. Repeated rows are one class of the second stage: one stays. Of ties the smallest doc_id stays. Texts are read whole, an
empty table gives an empty result, and further columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import exact_dedup, minhash_dedup, packing, quality, substring_dedup
from hushframe.llm.common import stage, written
from hushframe.sources.session import importable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies between the thresholds of their language."""
    with stage(importable(spark)):
        return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with stage(importable(spark)):
        return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    with stage(importable(spark)):
        return minhash_dedup.keep_first(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that other documents hold too; each copy of a passage goes."""
    with stage(importable(spark)):
        return substring_dedup.keep_unrepeated(docs, substring_dedup.PASSAGE, substring_dedup.Words, across=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the training sequences."""
    with stage(importable(spark)):
        return packing.packed(docs)


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("passage dedup", passage_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
