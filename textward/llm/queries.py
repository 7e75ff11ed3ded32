"""The queries of the training-data operators, one for each, and the SQL to hold them against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, embedding_dedup, language_id, mixing, packing, quality_rules, secret_scan, sharding, simhash_dedup, warc
from .common import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The map of a table has a place of its own, where the next run finds it.
    name = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()
    return sharding.shard_documents(table(spark, sf_dir, "documents"), map_path=f"{shared_dir(spark)}/slot-maps/{name}")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_report(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scans, op3_warc_derivatives, op4_embedding_dedup, op5_sharding, op6_simhash_dedup,
        op7_chat_formatting, op8_packing, op9_language_id, op10_mixing,
    )
}

#: SQL has neither XXH64 (6), a forest (2), a tokenizer (8) nor context trees (9).
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.QUALITY_SQL,
    "op3_warc_derivatives": warc.WARC_SQL,
    "op4_embedding_dedup": embedding_dedup.LINKS_SQL,
    "op5_sharding": sharding.SHARD_SQL,
    "op7_chat_formatting": chat_format.CHAT_SQL,
    "op10_mixing": mixing.MIX_SQL,
}
