"""A corpus pipeline over ``documents``: classify, remove copies, keep one of near copies, mix, encode.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and columns of any name; all but the last give the columns that they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, exact_dedup, jaccard, mixing, quality
from tallyspark.llm.common import spent, spill
from tallyspark.llm.queries import RANKS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts score like any other; repeated rows go or stay together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the smallest id; null and empty are one text; repeated rows end as one."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 stays, that of the smallest id; a null id loses; texts without words all stay; repeated rows end as one."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens stay, chosen by domain, language and source weights; null names are empty ones; rows of one id in a leaf go or stay together."""
    return mixing.keep_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to, as digests; null and empty texts have no ids; repeated rows stay."""
    return bpe.digests(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify), ("exact_dedup", deduplicate), ("ngram_jaccard", near_duplicates), ("source_mixing", mix),
    ("bpe_encode", encode),
]

#: Trees, components and BPE can't be said in SQL: the whole chain is tested against one of plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with spent(spark) as keep:  # what a stage wrote on its way goes once its result stands
            docs = keep(spill(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
