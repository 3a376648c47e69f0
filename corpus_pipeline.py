"""A training corpus from raw documents: language, copies, near copies, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagledger.llm.common import staged
from lagledger.llm.exact_dedup import drop_copies
from lagledger.llm.language_id import identify_rows
from lagledger.llm.mixing import mixed_rows
from lagledger.llm.ngram_join import drop_near_copies
from lagledger.llm.packing import pack
from lagledger.llm.queries import word_tokenizer

MOST_PASSES = 1.25  # over a small source; every document is passed once


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with a letter. Filters are fitted on the labelled rows of ``docs``."""
    return identify_rows(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the largest id, of each group of equal texts."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by 3-word shingles at Jaccard 0.9."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, documents of small sources again as the temperature's weights ask."""
    return mixed_rows(docs, most_passes=MOST_PASSES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None  # packing needs a tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, "corpus")
    return docs
