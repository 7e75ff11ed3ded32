"""Corpus pipeline: language ID, SimHash near-dedup, secret scans, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one
before it kept. All but the last return the columns of documents; the last
returns a row for each packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import language_id, mixing, packing, secret_scan, simhash_dedup
from textward.llm.common import drop_staged
from textward.llm.common import stage as staged
from textward.llm.common import table

#: Share of the tokens that the mixing stage keeps at least, however rare the rarest source is.
LEAST_SHARE = 2 / 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: no letter, no text, no language with half of the score, or none that explains the text."""
    return language_id.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Edited copies count: candidates
    within 8 of 64 bits are verified by 128 more."""
    return simhash_dedup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked, and n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics.

    It has two thirds of the tokens at least; a source or language too rare for that is kept whole.
    """
    return mixing.sample(docs, least_share=LEAST_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


#: (name, function) in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the context trees nor the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what one keeps is written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, staged(function(spark, docs, sf_dir), name)
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
