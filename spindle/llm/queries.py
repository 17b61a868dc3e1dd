"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm import mixing
from spindle.llm.common import table
from spindle.llm.decontaminate import leaked_spans
from spindle.llm.jaccard_join import jaccard_components
from spindle.llm.kneser_ney import quality_by_perplexity
from spindle.llm.language import identify_languages
from spindle.llm.quality_rules import quality_rules
from spindle.llm.secrets import scan_secrets
from spindle.llm.surrogates import replace_entities
from spindle.llm.token_files import END_ID, token_id_files
from spindle.llm.toxicity import toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of the session's ``spindle.surrogate.key``; made-up tables, which hold nobody's data, do with a public one."""
    return spark.conf.get("spindle.surrogate.key", "no secret: for the synthetic tables of the registered query").encode()


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_by_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_language_id, op3_pii_surrogates, op4_mixing, op5_quality_rules,
    op6_benchmark_decontamination, op7_secret_scan, op8_toxicity, op9_token_ids, op10_quality_classifier,
)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE_SQL}
