"""From raw documents to token records: each stage reads what the one before kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, near_dup, quality, tokens
from tidemark.llm.common import shared_table, table
from tidemark.llm.queries import END_ID, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_dup.drop_near_duplicates(docs)


def benchmark_containment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources come near their target weights."""
    return mixing.apply_mix(docs, mixing.mixed(docs))


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents left; the rows are read back from the written files."""
    return tokens.encoded(docs, tokenizer_path(), END_ID, remember=48 << 20)  # earlier stages have taken memory too


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark containment", benchmark_containment),
    ("source mix", source_mix),
    ("token records", token_records),
]

#: Near duplicates, rounding and token ids are no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
