"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, filter_audit, line_dedup, merkle, mixing, quality_rules
from .decontaminate import contamination, digest
from .language import identify
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality_model import classify_quality
from .secrets import secret_scan
from .token_output import token_output

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public tokenizer of the token output lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


def op2_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(spark, table(spark, sf_dir, "pages"))


def op4_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest(found)


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark, table(spark, sf_dir, "documents"))


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering_audit(spark, table(spark, sf_dir, "documents"))


def op12_assignment_aware_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_chat_snapshot_collapse": op1_chat_snapshot_collapse,
    "op2_co_trained_quality": op2_co_trained_quality,
    "op3_site_relative_lines": op3_site_relative_lines,
    "op4_language_bitmask_filters": op4_language_bitmask_filters,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_prefix_filtered_decontamination": op6_prefix_filtered_decontamination,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_risk_controlled_rules": op8_risk_controlled_rules,
    "op9_bit_packed_tokens": op9_bit_packed_tokens,
    "op10_curriculum_mix": op10_curriculum_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_assignment_aware_secrets": op12_assignment_aware_secrets,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_snapshot_collapse": chat.SQL,
    "op3_site_relative_lines": line_dedup.SQL,
    "op8_risk_controlled_rules": quality_rules.SQL,
    "op10_curriculum_mix": mixing.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_filter_interaction_audit": filter_audit.SQL,
}
