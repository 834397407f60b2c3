"""A training-data pipeline over ``documents``: each stage reads all that the one before it kept.

Stages take null, empty and very long texts, ties, repeated rows and ids, empty tables and further columns of any names; what
becomes of each is stated at the operator that a stage calls. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kakusu.llm import bpe, linededup, mixing, neardup, quality
from kakusu.llm.common import keep
from kakusu.llm.queries import table, vocabulary_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Positive-unlabelled quality classifier: rows scored below 0.3 go. Null and empty texts are scored too, see ``keep_good``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; every document stays, see ``dedup_lines``."""
    return linededup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, 0.8), see ``keep_one``."""
    return neardup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 2 times; texts without words never, see ``apply_mix``."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mix; none for a null or empty text, see ``encode_documents``."""
    return bpe.encode_documents(docs, vocabulary_path(), keep=("doc_id", "source"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them the rows are Parquet in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
