"""From raw documents to packed training tokens.

Each stage takes the documents that its predecessor kept, reread from Parquet, and
returns those it keeps with all their columns; the last one returns the written
tokens' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgergraph.llm import mixing
from ledgergraph.llm.decontaminate import remove_contaminated
from ledgergraph.llm.language import keep_identified
from ledgergraph.llm.near_dedup import keep_one
from ledgergraph.llm.queries import table, tokenizer_path
from ledgergraph.llm.token_output import token_output
from ledgergraph.functions.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language, or far from all, go."""
    return keep_identified(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return keep_one(spark, docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order."""
    return mixing.take(spark, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids are written bit-packed in the order of the mix, which is that of the rows in
    their files (of ids, if there are none); the rows come from the written segments."""
    return token_output(spark, docs, tokenizer_path(), order=mixing.written_order(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: The language, near-duplicate and token stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
