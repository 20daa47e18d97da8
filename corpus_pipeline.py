"""A corpus pipeline: each stage reads what the stage before it wrote.

quality rules -> MinHash near-duplicates -> secret scan -> source mix -> packing. All but the last return the columns of the
documents table; the last returns the packed sequences. Null and empty texts leave at the first stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm import mixing, near_dedup, packing, quality, secret_scan
from paneltide.scale import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that fail, or lose too much, go."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced in the text."""
    return secret_scan.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, sequence and offset."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: Shingle sets, character models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
