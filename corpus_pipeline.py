"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each near-duplicate group stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: credentials are masked in the texts, and n_chars follows.
5. packing: what is left is packed into sequences of at most 2048 tokens.

Each stage takes all that its predecessor kept, as a written table, and decides every row by
itself, also where ids are null or repeated: rows are dropped or masked in the pass that reads
their texts, and near duplicates by a number of each row. SQL cannot express a trained
classifier, inferred automata or a tokenizer, so ORACLE_SQL is None; the tests hold near
duplicates, decontamination, masking and packing against brute-force versions and the
classifier's stage against its scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontamination, packing, quality, secrets, similarity
from larkspur.llm.kit import small_batches, written
from larkspur.llm.kit import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stored(small_batches(spark), sf_dir, name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similarity.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the pieces of packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
