"""A training-data pipeline over documents: quality rules, near-duplicates, repeated passages, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last keep
the columns of documents, whatever further ones there are. A null text counts as empty (the quality
rules reject it), a null doc_id as the smallest; of repeated rows one stays; very long texts are
taken whole; ties go by doc_id, then text hash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ngram_join, packing, quality_rules, suffix_dedup
from gridloom.llm.common import scratch_path, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line field is trained on the labels beside the documents."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id."""
    return ngram_join.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffix_dedup.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return packing.packing(docs)


STAGES = [("quality_rules", good), ("ngram_join", distinct), ("suffix_dedup", unrepeated), ("packing", packed)]
#: The field, the classes and the repeats are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents: doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding of every document that stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
