"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm import (byte_bpe, collocations, language_crf, lm_difference, packing, quality_embed, quality_rules,
                           secret_scan, shared_queries, simhash_dedup, topk_threshold, url_filter, warc_derivatives)
from newsprism.llm.common import pick, read_table


def op1_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_threshold.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        F.sha2(secret_scan.describe(F.col("found"), secret_scan.BASE_KINDS).cast("binary"), 256)
                        .alias("base_sha256"),
                        secret_scan.describe(F.col("found"), secret_scan.KINDS).alias("spans"))


def op5_quality_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_embed.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(read_table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    responses = pages.select("page_id", "url", warc_derivatives.response_id(F.col("page_id"), F.col("url")).alias("id"),
                             F.lit("1970-01-01T00:00:00Z").alias("date"),
                             warc_derivatives.response_block(F.col("html")).alias("block"))
    return warc_derivatives.derivatives(responses, "page_id", "id", "url", "date", "block").select(
        F.col("key").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri",
        "content_length", "block_digest", "source_block_digest", "source_payload_digest", "block")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op9_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = pick(read_table(spark, sf_dir, "labels"), id="doc_id", quality="quality").where("quality = 1")
    return lm_difference.score(read_table(spark, sf_dir, "documents"), good)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


#: Rules of the URL filter: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op12_shared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_queries.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_topk_threshold": op1_topk_threshold,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_crf": op3_language_crf,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_embed": op5_quality_embed,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_quality_rules": op7_quality_rules,
    "op8_cost_packing": op8_cost_packing,
    "op9_lm_difference": op9_lm_difference,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_shared_queries": op12_shared_queries,
    "op13_collocations": op13_collocations,
}
