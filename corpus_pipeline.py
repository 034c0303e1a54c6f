"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination and packing, each stage on all that
its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the shared folder and reads
back as the next stage's documents, so a lost executor repeats one stage at most. All stages but the last return the
columns of documents; the last returns the pieces of `packing.pack`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import decontaminate, exact_dedup, language_id, packing, simhash_dedup
from cartolith.llm.queries import tokenizer_path
from cartolith.session import configure, cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language the classifier cannot tell."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.dedup_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Trained models, fingerprint components and tokens have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
