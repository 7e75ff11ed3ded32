"""Sources: labelled corpora, requests, lexicon files, thresholds, saved models."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C

STRINGS = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
ROOTS = STRINGS("Word", "Category", "Severity", "Note")
MANUAL = STRINGS("Word", "Variation", "Note")
WHITELIST = STRINGS("Phrase", "Scope", "Reason")
COMMENTS = STRINGS("comment", *C.LABELS)
REQUEST = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("text", T.StringType()),
     T.StructField("surface", T.StringType()), T.StructField("context", T.StringType())]
)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a scan with fewer splits than cores (one small file) is dealt out once. Large inputs have
    more splits than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations") else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header, all cells as strings; quoted cells may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Labelled comments: comment, and each label as 0 or 1."""
    rows = read_csv(spark, path, COMMENTS)
    return rows.select("comment", *[F.col(c).cast("double").cast("int").alias(c) for c in C.LABELS])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = C.SPLIT_SEED) -> DataFrame:
    """n rows, chosen by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, text, toxic and quality as 0 or 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as moderation requests: users write in private, others in public."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when(F.col("role") == "user", "private").otherwise("public").alias("surface")
    )


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests that arrive as JSON lines in a folder."""
    return spark.readStream.schema(REQUEST).json(path)


def load_thresholds(path: str | None) -> dict[str, float]:
    """Threshold of each label from a JSON file; without a readable one, the default for all."""
    try:
        with open(path or "", encoding="utf-8") as f:
            stored = json.load(f)
    except (OSError, ValueError):
        return dict.fromkeys(C.LABELS, C.DEFAULT_THRESHOLD)
    default = stored.get("default", C.DEFAULT_THRESHOLD)
    return {label: float(stored.get("thresholds", {}).get(label, default)) for label in C.LABELS}


def load_model(path: str, required: bool = False):
    """A saved pipeline, or None if there is none and it is not required."""
    from pyspark.ml import PipelineModel

    try:
        return PipelineModel.load(path)
    except Exception:  # the reader raises what the file system raises
        if required:
            raise
        return None


def literal(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of constants, made in the plan."""
    if not rows:
        raise ValueError("a literal table needs rows")
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


Scorer = Callable[[DataFrame], DataFrame]
"""Rows with id columns and text to the same ids with label and score."""


def load_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lookup, whitelist) from the built CSV files bad_words, word_variations and whitelist of a folder."""
    from ..operators.lexicon import lookup

    words = read_csv(spark, f"{folder}/bad_words.csv", STRINGS("Id", "Word", "NormalizedWord", "Category", "Severity"))
    variations = read_csv(spark, f"{folder}/word_variations.csv", STRINGS("Id", "BadWordId", "Variation", "NormalizedVariation", "Source"))
    white = read_csv(spark, f"{folder}/whitelist.csv", STRINGS("Phrase", "NormalizedPhrase", "Scope", "Reason"))
    numbers = words.withColumns({"Id": F.col("Id").cast("int"), "Severity": F.col("Severity").cast("int")})
    return lookup(numbers, variations.withColumn("BadWordId", F.col("BadWordId").cast("int"))), white
