"""Training-corpus pipeline: quality rules, language, near duplicates, secrets, packing.

Each stage works on all that the one before kept. The stages before packing return
the columns of ``documents``; packing returns one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsprism.llm import language_crf, packing, quality_rules, secret_scan, simhash_dedup
from newsprism.session import cut_lineage, reach_workers


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents they reject go."""
    return quality_rules.keep_good(docs)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language of sufficient score go."""
    return language_crf.keep_identified(docs)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near duplicates: one document of each group stays, the one of least doc_id."""
    return simhash_dedup.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret found is replaced; no document goes."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cost-balanced packing into sequences of 2048 tokens; ids are packed little-endian 32-bit integers."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_identified),
    ("simhash_near_dedup", keep_representatives),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: A conditional random field and a tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    reach_workers(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
