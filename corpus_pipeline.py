"""Corpus pipeline: one operator after another over ``documents``, each stage written as Parquet and read again.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``: texts without a known language go, one document of each group of
near copies stays (five-word shingles, similarity 0.8), documents that hold a
benchmark passage go, sources are mixed to their weights, a row for each copy;
the last writes the token files and returns their digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm.common import released, stored, table
from spindle.llm.decontaminate import clean_documents
from spindle.llm.jaccard_join import one_of_each_group
from spindle.llm.language import accepted_documents
from spindle.llm.mixing import mixed_documents
from spindle.llm.queries import tokenizer_path
from spindle.llm.token_files import token_id_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_id_files(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL cannot express the learned and approximate stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        released(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
