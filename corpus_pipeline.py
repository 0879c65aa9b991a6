"""Corpus pipeline: quality rules, near duplicates, benchmark leaks, secrets, token ids.

Every stage takes the documents that the one before has kept, with the columns
of ``documents``, and decides on all of them.  The last one returns token ids
in place of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.llm import bpe, jaccard, leaks, quality, secrets
from hearthmark.llm.queries import table, vocabulary_bytes

#: Words of a shingle and similarity in hundredths from which documents count as copies.
SHINGLE_WORDS, SIMILAR = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    """Let ``n_chars`` be the length of the text again."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines are taken out; documents that lose too much or fail the base rules go."""
    judged = quality.judge(docs, cleaned="text").where("kept")
    return _measured(judged.select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the smallest doc_id stays."""
    return jaccard.without_copies(docs, SHINGLE_WORDS, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, also where they were encoded."""
    return _measured(secrets.scan(docs, spans="_spans", redacted="text").select(docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, decoded and compared where they are made."""
    return bpe.encode(docs, vocabulary_bytes("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("token_ids", token_ids),
]

#: Similarity groups, edit distances, nested encodings and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
