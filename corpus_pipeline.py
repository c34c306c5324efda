"""A training corpus from ``documents``: quality rules, exact and near deduplication, a mix of sources, token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
hands what it reads back to the next. All but the last return the columns of documents.

Defined cases: null texts are empty ones (quality rules reject them); rows are known by themselves, not by identifiers, so
null and repeated identifiers lose nothing; rows that repeat identifier and text are one document; ties are broken as the
operators say; a table without rows gives none; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe, exactdedup, mixing, quality, simhash
from stratalog.llm.common import read, remove, scratch, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, as they are; rejected ones go."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each different text: the longest original, then the smallest identifier (null last)."""
    return exactdedup.keep_owners(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest identifier's (null last)."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its slots."""
    return mixing.mix(docs)


def bpe_digest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's identifiers and decoded text."""
    return bpe.digest(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe_digest", bpe_digest)]

#: Fingerprints and the tokenizer's merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's scratch tables, and the table before it, go once its own is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
