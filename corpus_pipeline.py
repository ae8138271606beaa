"""The corpus pipeline: each stage takes the documents its predecessor kept and hands on what it keeps.

All but the last stage return the columns of documents; the last returns the pieces of the packed sequences.
The session's Arrow batches are made smaller, since whole texts go to Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from packlens.llm.common import stash, table, text_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go; documents that the rules reject go."""
    text_batches(spark)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    text_batches(spark)
    return ngram_join.keep_one(docs, ngram_join.Join(n=5, share=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur twice go; every document stays."""
    text_batches(spark)
    return suffix_dedup.clean(docs, suffix_dedup.Repeats(200))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    text_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids along the space-filling curve."""
    text_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packed),
]

#: Fingerprints, spans of repeated bytes and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
