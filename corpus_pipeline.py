"""Corpus pipeline: language ID, toxicity, near-duplicate join, packing; each stage works on all that the one before kept.

Every stage but the last returns the columns of documents. SQL cannot state it (models are fitted): ORACLE_SQL is None, and
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard, language, packing, toxicity
from strandline.llm.queries import WORD_TOKENIZER, learning, table
from strandline.session import stage

ORACLE_SQL = None


def decided_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression decides; the rest (no letters, tied languages) go."""
    return language.identified(docs, language.fit(learning(docs)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores below the threshold."""
    return toxicity.without_toxic(docs, toxicity.fit(learning(docs), table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    return jaccard.one_per_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [("language", decided_language), ("toxicity", not_toxic), ("near duplicates", one_of_each_group), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
