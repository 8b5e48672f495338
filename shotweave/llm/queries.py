"""The registered queries ``opN_<name>`` and their DuckDB SQL, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shotweave.llm import (bpe_codec, decontam, language_id, license_scan, line_dedup, merkle_manifest, minhash_forest, oracles, prefix_trie, quality_rules, suffix_dedup,
                            token_count, url_filter, warc)

URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"),
             url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others are tested against brute force, the tokenizers' own libraries, or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op6_minhash_forest": oracles.NEAR_DUPLICATE_SQL,
    "op7_license_scan": oracles.license_sql(),
    "op10_url_filter": oracles.url_sql(URL_RULES),
    "op11_warc_segments": oracles.WARC_SQL,
    "op12_prefix_trie": oracles.TRIE_SQL,
    "op13_merkle_manifest": oracles.MANIFEST_SQL,
}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(_read(spark, sf_dir, "documents"))


@_query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"), URL_RULES)


@_query
def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_read(spark, sf_dir, "documents"))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


@_query
def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return merkle_manifest.manifest(docs, merkle_manifest.newline_loss(docs))
