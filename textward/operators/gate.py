"""The gate: lexicon matches and scores to block, review or allow; policy per surface; audit; requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def decide(checked: DataFrame, score: str | None = "toxicity_score") -> DataFrame:
    """checked (from match.check, with a score column or none) plus action, reason, allowed.

    The first rule that holds: block by severity, block by score, review for any match, review by score, allow.
    """
    s = F.coalesce(F.col(score), F.lit(0.0)) if score else F.lit(0.0)
    by_words = lambda words: F.format_string("lexicon severity %d: %s", F.col("max_severity"), F.array_join(words, ", "))
    by_score = lambda t: F.format_string(f"classifier toxicity %.2f >= {t}", s)
    rules = [
        (F.col("max_severity") >= C.BLOCK_SEVERITY, "block", by_words("block_words")),
        (s >= C.BLOCK_SCORE, "block", by_score(C.BLOCK_SCORE)),
        (F.col("is_flagged"), "review", by_words("words")),
        (s >= C.REVIEW_SCORE, "review", by_score(C.REVIEW_SCORE)),
    ]
    action, reason = F.lit("allow"), F.lit("no signal")
    for holds, a, why in reversed(rules):
        action, reason = F.when(holds, a).otherwise(action), F.when(holds, why).otherwise(reason)
    return checked.withColumns(
        {"action": action, "reason": reason, "allowed": action == "allow", "toxicity_score": F.round(s, 3)}
    )


def apply_policy(decided: DataFrame, surface: Column | str = "surface") -> DataFrame:
    """decided plus proceed and outcome: reviewed text is held where others would read it."""
    surface = F.col(surface) if isinstance(surface, str) else surface
    outcome = (
        F.when(F.col("action") == "block", "blocked")
        .when((F.col("action") == "review") & (surface == "public"), "held_for_review")
        .when(F.col("action") == "review", "allowed_flagged")
        .otherwise("allowed")
    )
    return decided.withColumn("outcome", outcome).withColumn("proceed", ~F.col("outcome").isin("blocked", "held_for_review"))


def flag_categories(scores: DataFrame, ids: list[str], thresholds: dict[str, float] = C.CATEGORY_THRESHOLDS) -> DataFrame:
    """scores(ids, label, score) in long form to the reported ones: ids, label, score (3 places), is_advisory.
    The label toxicity is never reported."""
    least = F.lit(C.DEFAULT_THRESHOLD)
    for label, t in thresholds.items():
        least = F.when(F.col("label") == label, t).otherwise(least)
    kept = scores.where((F.col("label") != "toxicity") & (F.col("score") >= least))
    return kept.select(*ids, "label", F.round("score", 3).alias("score"), F.col("label").isin(C.ADVISORY).alias("is_advisory"))


def category_maps(flagged: DataFrame, ids: list[str]) -> DataFrame:
    """ids, flagged_categories (label to score), advisory_categories (sorted)."""
    return flagged.groupBy(*ids).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "score")))).alias("flagged_categories"),
        F.array_sort(F.collect_list(F.when(F.col("is_advisory"), F.col("label")))).alias("advisory_categories"),
    )


def invalid(requests: DataFrame) -> Column:
    """Why a request is not accepted; null if it is."""
    column = lambda n: F.col(n) if n in requests.columns else F.lit(None).cast("string")
    return (
        F.when(F.col("text").isNull(), "text missing")
        .when(F.length("text") > C.MAX_TEXT, "text too long")
        .when(~F.coalesce(column("surface"), F.lit("public")).isin("private", "public"), "unknown surface")
        .when(F.length(column("context")) > C.MAX_CONTEXT, "context too long")
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with surface defaulting to public, rejected with why)."""
    judged = requests.withColumn("why", invalid(requests))
    return (
        judged.where("why is null").drop("why").withColumn("surface", F.coalesce("surface", F.lit("public"))),
        judged.where("why is not null"),
    )


def oversized_batches(requests: DataFrame, batch: str) -> DataFrame:
    """Batches of more than MAX_BATCH requests: batch, n."""
    return requests.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > C.MAX_BATCH)


def audit(answered: DataFrame, *extra: str) -> DataFrame:
    """Entries of the audit log: all that was not allowed. The caller adds the time when it writes."""
    context = F.col("context") if "context" in answered.columns else F.lit(None).cast("string")
    return answered.where("action <> 'allow'").select(
        *extra, "surface", context.alias("context"), "action", "outcome", "reason", "toxicity_score", F.col("words").alias("matched_words"), "text"
    )


def response(answered: DataFrame, *ids: str) -> DataFrame:
    """What a caller gets; `allowed` stays inside. Categories are empty where answered has none (see category_maps);
    latency_ms is the time since `received_at`, null without it."""
    has = lambda n, kind: F.col(n) if n in answered.columns else F.lit(None).cast(kind)
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,double>")
    since = F.unix_micros(F.current_timestamp()) - F.unix_micros(has("received_at", "timestamp"))
    return answered.select(
        *ids, "action", "proceed", "outcome", "reason", "toxicity_score", F.col("max_severity").alias("lexicon_severity"),
        F.coalesce("matches", F.array().cast(answered.schema["matches"].dataType)).alias("lexicon_matches"),
        F.coalesce(has("flagged_categories", "map<string,double>"), empty).alias("flagged_categories"),
        F.coalesce(has("advisory_categories", "array<string>"), none).alias("advisory_categories"), (since / 1000).alias("latency_ms"),
    )


def health(lexicon: DataFrame, has_classifier: bool) -> DataFrame:
    return lexicon.agg(F.count(F.lit(1)).alias("lexicon_forms")).select(
        F.lit("ok").alias("status"), "lexicon_forms", F.lit(has_classifier).alias("classifier_loaded"), F.current_timestamp().alias("loaded_at")
    )
