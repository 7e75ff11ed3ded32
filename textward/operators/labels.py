"""Label repair and splits: near-duplicate votes, grouped stratified splits, lexicon audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import near_key


def _groups(rows: DataFrame, labels: list[str], *more: Column) -> DataFrame:
    """Groups of rows(_key, labels) that disagree, but for that of empty keys: _key, n, positives of each label."""
    # Asked of the aggregate, the condition on the key is not pushed below either.
    groups = rows.groupBy("_key").agg(
        F.min("_key").alias("some"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"pos_{c}") for c in labels], F.size(F.collect_set(F.struct(*labels))).alias("kinds"), *more
    )
    return groups.where((F.col("some") != F.md5(F.lit(""))) & F.expr("n >= 2 and kinds > 1")).drop("kinds", "some")


def _digest(near: Column) -> Column:
    """What rows are grouped by in place of the whole text. Never null: a join's own null filter would be pushed
    down to the scan and work out the key once more there."""
    return F.md5(F.coalesce(near, F.lit("")))


def vote_groups(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Near-duplicate groups whose rows disagree: near_key, n, and for each label its positives."""
    keyed = rows.withColumn("near_key", near_key(F.col("text"))).withColumn("_key", _digest(F.col("near_key")))
    return _groups(keyed, labels, F.min("near_key").alias("near_key")).select("near_key", "n", *[f"pos_{c}" for c in labels])


def vote(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows with the majority label of their group, ties positive, and `changed`. Only groups that disagree
    are joined back, so the votes stay small whatever the number of copies; keys are digests, never texts."""
    keyed = rows.withColumn("_key", _digest(near_key(F.col("text"))))
    joined = keyed.join(_groups(keyed, labels), "_key", "left")
    new = {c: F.when(F.col("n").isNull(), F.col(c)).otherwise((F.col(f"pos_{c}") * 2 >= F.col("n")).cast("int")) for c in labels}
    changed = F.lit(False)
    for c in labels:
        changed = changed | (new[c] != F.col(c))
    return joined.select(*[c for c in rows.columns if c not in labels], *[new[c].alias(c) for c in labels], changed.alias("changed"))


def ties(groups: DataFrame, labels: list[str]) -> Column:
    """Number of labels of a group that were tied."""
    total = F.lit(0)
    for c in labels:
        total = total + (F.col(f"pos_{c}") * 2 == F.col("n")).cast("int")
    return total


def ranked(groups: DataFrame, by: str, order: Column) -> DataFrame:
    """groups with `place` (from 0) and `of` within each value of `by`, ordered by a hexadecimal digest.

    A value may hold half of all groups, so places come in two steps: the rank within a bucket of digests, and
    the number of groups in the buckets before it.
    """
    rows = groups.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, 3))
    sizes = rows.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(by).orderBy("_b")
    sizes = sizes.select(by, "_b", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("of"))
    own = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_d"))
    placed = rows.withColumn("_own", own).join(F.broadcast(sizes), [by, "_b"])  # at most 4096 buckets a value
    return placed.withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_d", "_b", "_own", "_before")


def split(rows: DataFrame, label: str = "toxic", train: float = C.TRAIN_SHARE, val: float = C.VAL_SHARE, seed: int = C.SPLIT_SEED) -> DataFrame:
    """rows with near_key and split: near-duplicates stay together, classes keep their shares.

    A group's class is the rounded mean of its labels, a half counting as 0. Within a class the groups are cut
    in order of a seeded digest: the first train share (rounded down), then the val share, then test.
    """
    own = F.when(F.col("near_key") != "", F.col("near_key")).otherwise(F.col("text"))
    keyed = rows.withColumn("near_key", near_key(F.col("text"))).withColumn("near_key", F.coalesce(own, F.lit("")))
    # The digest that orders the groups also names them, so no text is shuffled to form them.
    keyed = keyed.withColumn("_group", F.md5(F.concat(F.col("near_key"), F.lit(f"|{seed}"))))
    groups = keyed.groupBy("_group").agg((F.avg(label) > 0.5).cast("int").alias("stratum"))
    placed = ranked(groups, "stratum", F.col("_group"))
    n_train, n_val = F.floor(F.col("of") * train), F.floor(F.col("of") * val)
    named = placed.withColumn(
        "split", F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_val, "val").otherwise("test")
    )
    return keyed.join(named.select("_group", "split"), "_group").drop("_group")


def positive_rates(splits: DataFrame, label: str = "toxic") -> DataFrame:
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("positive_rate"))


def review_queue(checked: DataFrame, label: str = "toxic") -> DataFrame:
    """checked (with split and the label) to its rows that are labelled clean and match the lexicon: what is
    proposed, whether it is applied, and why not."""
    applied = (F.col("max_severity") >= C.AUTO_SEVERITY) & (F.col("split") == "train")
    why = (
        F.when(applied, "").when(F.col("split") != "train", "val/test held out")
        .otherwise(F.format_string("severity %d below auto-apply threshold", F.col("max_severity")))
    )
    return checked.where((F.coalesce(label, F.lit(0)) != 1) & F.col("is_flagged")).select(
        "split", "doc_id", F.array_join("words", ", ").alias("MatchedWords"), F.col("max_severity").alias("Severity"),
        F.array_join("categories", ", ").alias("LexiconCategories"), F.col(label).alias("CurrentToxicity"),
        F.lit(1).alias("ProposedToxicity"), applied.alias("Applied"), why.alias("WhyNotApplied"),
    )


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("split").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(F.col("Applied").cast("int")).alias("applied"), F.sum((~F.col("Applied")).cast("int")).alias("review_only")
    )


def relabel(checked: DataFrame, label: str = "toxic", categories: dict[str, str] | None = None) -> DataFrame:
    """The train rows of checked with the applied repairs: the label set, and with it each matched category
    that is a column (categories maps a category to its column)."""
    apply = (F.coalesce(label, F.lit(0)) != 1) & F.col("is_flagged") & (F.col("max_severity") >= C.AUTO_SEVERITY)
    out = checked.where("split = 'train'").withColumn("repaired", apply)
    out = out.withColumn(label, F.when(F.col("repaired"), 1).otherwise(F.col(label)))
    for category, column in (categories or {c: c for c in C.LABELS if c in checked.columns and c != label}).items():
        out = out.withColumn(column, F.when(F.col("repaired") & F.array_contains("categories", category), 1).otherwise(F.col(column)))
    return out
