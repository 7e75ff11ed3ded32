"""Corpus mining: document frequencies of keys by class, smoothed log-odds, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import keys, tokens


def token_rows(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, pos (from 0), token, key of every token; keys may be empty."""
    both = F.arrays_zip(tokens(F.col("text")).alias("token"), keys(F.col("text")).alias("key"))
    return df.select(*ids, F.posexplode(both).alias("pos", "_b")).select(*ids, "pos", "_b.token", "_b.key")


def document_keys(df: DataFrame, min_length: int = 1) -> DataFrame:
    """df with `key`: each distinct key of each row's text once."""
    kept = F.filter(F.array_distinct(keys(F.col("text"))), lambda k: F.length(k) >= min_length)
    return df.withColumn("key", F.explode(kept)).drop("text")


def key_counts(docs: DataFrame, min_length: int = 1, categories: tuple[str, ...] = ()) -> DataFrame:
    """docs(text, toxic, categories...): for each key the toxic and clean documents that have it,
    and the toxic documents of each category."""
    rows = document_keys(docs.select("text", "toxic", *categories), min_length)
    toxic = F.col("toxic") == 1
    return rows.groupBy("key").agg(
        F.sum(F.when(toxic, 1).otherwise(0)).alias("toxic_count"),
        F.sum(F.when(toxic, 0).otherwise(1)).alias("clean_count"),
        *[F.sum(F.when(toxic & (F.col(c) == 1), 1).otherwise(0)).alias(f"n_{c}") for c in categories],
    )


def class_sizes(docs: DataFrame) -> DataFrame:
    """One row: toxic_docs, clean_docs."""
    toxic = F.col("toxic") == 1
    return docs.agg(F.sum(F.when(toxic, 1).otherwise(0)).alias("toxic_docs"), F.sum(F.when(toxic, 0).otherwise(1)).alias("clean_docs"))


def log_odds(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """counts plus log_odds of each key, smoothed by half a document."""
    share = lambda n, of: (F.col(n) + 0.5) / (F.col(of) + 0.5)
    both = counts.join(F.broadcast(sizes))  # sizes is a single row
    return both.withColumn("log_odds", F.log(share("toxic_count", "toxic_docs") / share("clean_count", "clean_docs")))


def candidates(
    docs: DataFrame, categories: tuple[str, ...] = (), min_toxic: int = C.MIN_TOXIC,
    min_log_odds: float = C.MIN_LOG_ODDS, min_length: int = C.MIN_KEY,
) -> DataFrame:
    """Keys that lean toxic: Candidate, LogOdds, ToxicCount, CleanCount, SuggestedCategory, CategoryCount.

    The suggested category is the most frequent, the first in order of `categories` among equals, and empty if
    none of the toxic documents has one. Ranked by LogOdds, then key.
    """
    rows = log_odds(key_counts(docs, min_length, categories).where(F.col("toxic_count") >= min_toxic), class_sizes(docs))
    most = F.greatest(*[F.col(f"n_{c}") for c in categories], F.lit(0)) if categories else F.lit(0)
    best = F.lit("")
    for c in reversed(categories):
        best = F.when((F.col(f"n_{c}") == most) & (most > 0), c).otherwise(best)
    return rows.where(F.col("log_odds") >= min_log_odds).select(
        F.col("key").alias("Candidate"), F.round("log_odds", 3).alias("LogOdds"), F.col("toxic_count").alias("ToxicCount"),
        F.col("clean_count").alias("CleanCount"), best.alias("SuggestedCategory"), most.cast("long").alias("CategoryCount"),
    ).orderBy(F.desc("LogOdds"), "Candidate")
