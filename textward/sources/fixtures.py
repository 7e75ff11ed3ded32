"""The lexicon that the registered queries use: words of the driver's documents, none of any real list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from .tables import literal

#: (word, category, severity)
ROOTS = [
    ("moron", "insult", 3), ("scum", "insult", 3), ("loser", "insult", 2), ("worthless", "insult", 2),
    ("pathetic", "insult", 1), ("disgusting", "obscene", 2), ("ering", "obscene", 1), ("tion", "identity_attack", 1),
    ("then", "threat", 1), ("thend", "threat", 2), ("morons", "insult", 2),
]
#: (word, variation)
MANUAL = [("moron", "m0rrown"), ("scum", "skumm"), ("nobody", "n0b0dy"), ("loser", "looser"), ("loser", "luzr")]
#: (phrase, scope, reason)
WHITELIST = [
    ("tionti", "exact", "a word of its own"), ("eringth", "prefix", "a family of its own"), ("the", "exact", "article"),
    ("thenea", "prefix", "a family of its own"), ("lösung", "exact", "a word of its own"),
]


#: Entries of small_lexicon.
N_SMALL = len(ROOTS)


def roots(spark: SparkSession) -> DataFrame:
    """Id (input position from 1), Word, Category, Severity."""
    return literal(spark, ["Id", "Word", "Category", "Severity"], [(i, *r) for i, r in enumerate(ROOTS, 1)])


def manual(spark: SparkSession) -> DataFrame:
    return literal(spark, ["Position", "Word", "Variation"], [(i, *r) for i, r in enumerate(MANUAL, 1)])


def whitelist(spark: SparkSession) -> DataFrame:
    from ..operators.lexicon import build_whitelist

    return build_whitelist(literal(spark, ["Phrase", "Scope", "Reason"], WHITELIST))


def small_lexicon(spark: SparkSession) -> DataFrame:
    """Lookup entries of the roots alone: NormalizedForm, BadWordId, Word, Category, Severity, MatchType."""
    return roots(spark).select(
        normalise(F.col("Word")).alias("NormalizedForm"), F.col("Id").alias("BadWordId"), "Word", "Category", "Severity",
        F.lit("base").alias("MatchType"),
    )
