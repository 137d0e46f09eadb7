"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.
What a stage works out before it returns takes text in small batches: executors
keep the heap and the workers of the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmat.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from gridmat.llm.common import SMALL_BATCHES, set_for, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and lie within the perplexity band of their language."""
    with set_for(spark, SMALL_BATCHES):
        return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by Jaccard similarity of word shingles."""
    with set_for(spark, SMALL_BATCHES):
        return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; documents that consisted of them go."""
    with set_for(spark, SMALL_BATCHES):
        return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that poor and toxic text is down to its target share."""
    with set_for(spark, SMALL_BATCHES):
        return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Perplexity, suffix order, classifier and tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
