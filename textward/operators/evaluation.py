"""Scores and their evaluation: linear scorer, confusion, threshold sweeps, obfuscation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import unit
from .mining import document_keys

BROADCAST_WEIGHTS = 500_000

#: Letters that the attack writes as digits.
ATTACK = ("aeiosAEIOS", "4310543105")


def linear_scores(texts: DataFrame, ids: list[str], weights: DataFrame | None, bias: float, sums: DataFrame | None = None) -> DataFrame:
    """texts(ids, text) with toxicity_score: sigmoid of bias and the weights of the distinct keys in the text.

    Up to BROADCAST_WEIGHTS weights(key, weight) are broadcast, more are joined by shuffle. Texts with none of the
    keys get the bias alone. key_sums of these texts, where they are at hand, take the place of weights.
    """
    return texts.join(key_sums(texts, ids, weights) if sums is None else sums, ids, "left").withColumn("toxicity_score", _chance(F.lit(bias))).drop("_w")


def _chance(bias: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(F.coalesce("_w", F.lit(0.0)) + bias))), 6)


def key_sums(texts: DataFrame, ids: list[str], weights: DataFrame) -> DataFrame:
    """ids, _w: the weights of each text's distinct keys, for texts that have any."""
    # The weights come from a pass over the whole corpus; brought to the driver once, they are not worked out again.
    few = weights.select("key", "weight").limit(BROADCAST_WEIGHTS + 1).collect()
    if not few:
        return texts.select(*ids).where("false").withColumn("_w", F.lit(0.0))
    side = F.broadcast(texts.sparkSession.createDataFrame(few, weights.select("key", "weight").schema)) if len(few) <= BROADCAST_WEIGHTS else weights
    hits = document_keys(texts.select(*ids, "text")).join(side, "key")
    return hits.groupBy(*ids).agg(F.sum("weight").alias("_w"))


def label_scores(texts: DataFrame, ids: list[str], weights: DataFrame | None, biases: dict[str, float], sums: DataFrame | None = None) -> DataFrame:
    """ids, label, score: as linear_scores, with a bias for each label."""
    each = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(float(b)).alias("bias")) for n, b in biases.items()])
    rows = texts.select(*ids).join(key_sums(texts, ids, weights) if sums is None else sums, ids, "left").withColumn("_l", F.explode(each))
    return rows.select(*ids, F.col("_l.label").alias("label"), _chance(F.col("_l.bias")).alias("score"))


def confusion(rows: DataFrame, predicted: Column, truth: Column, *by: str) -> DataFrame:
    """tp, fp, fn, clean_total, precision, recall, f1 (0 where undefined), for each value of `by`."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.groupBy(*by).agg(
        n(predicted & truth).alias("tp"), n(predicted & ~truth).alias("fp"), n(~predicted & truth).alias("fn"), n(~truth).alias("clean_total")
    )
    return with_f1(counts)


def with_f1(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"))


def hundredth(score: Column) -> Column:
    """The largest whole number of hundredths that the score reaches."""
    low = F.floor(score * 100)
    return F.when((low + 1) / F.lit(100.0) <= score, low + 1).when(low / F.lit(100.0) > score, low - 1).otherwise(low).cast("int")


def sweep(scored: DataFrame, *by: str, first: int = C.GRID_FROM, last: int = C.GRID_TO) -> DataFrame:
    """scored(by, score, truth as 0 or 1) to the metrics at every threshold of the grid: by, threshold (in
    hundredths), tp, fp, fn, precision, recall, f1.

    One pass into a histogram of at most 101 buckets; thresholds are its running sums.
    """
    bins = scored.withColumn("_b", F.least(F.lit(last), hundredth(F.col("score")))).groupBy(*by, "_b").agg(
        F.sum("truth").alias("_p"), F.sum(1 - F.col("truth")).alias("_n")
    )
    total = bins.groupBy(*by).agg(F.sum("_p").alias("_all"))
    grid = total.withColumn("threshold", F.explode(F.sequence(F.lit(first), F.lit(last))))
    at = [*by, "threshold"]
    joined = grid.join(bins, [grid[c].eqNullSafe(bins[c]) for c in by] + [bins["_b"] >= grid["threshold"]], "left").select(
        *[grid[c] for c in by], "threshold", "_all", "_p", "_n"
    )
    counts = joined.groupBy(*at, "_all").agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_n"), F.lit(0)).alias("fp"))
    return with_f1(counts.withColumn("fn", F.col("_all") - F.col("tp")).drop("_all"))


def best(swept: DataFrame, *by: str) -> DataFrame:
    """by, threshold, f1: the lowest of the best thresholds; the default where none scores above 0."""
    top = swept.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m"))
    some = F.col("m.f1") > 0
    return top.select(*by, F.when(some, -F.col("m.t") / F.lit(100.0)).otherwise(C.DEFAULT_THRESHOLD).alias("threshold"), F.col("m.f1").alias("f1"))


def decide_thresholds(scored: DataFrame, label: str, row_id: str, min_support: int = C.MIN_SUPPORT, seed: int = C.SPLIT_SEED) -> DataFrame:
    """scored(label, row_id, score, truth) to label, threshold, reason, support.

    A label with too few positives keeps the default. Else a threshold is fitted on half of the rows; if it does
    not beat the default on the other half, the default stays; else it is fitted again on all rows.
    """
    halves = scored.withColumn("fit", unit(F.col(row_id), F.lit(seed)) < 0.5)
    support = scored.groupBy(label).agg(F.sum("truth").alias("support"))
    swept = sweep(halves, label, "fit")
    candidate = best(swept.where("fit"), label).select(label, F.round(F.col("threshold") * 100).cast("int").alias("_t"))
    held = swept.where("not fit")
    at = held.join(candidate, label).where(F.col("threshold") == F.col("_t")).select(label, F.col("f1").alias("_f_fit"))
    plain = held.where(F.col("threshold") == int(C.DEFAULT_THRESHOLD * 100)).select(label, F.col("f1").alias("_f_default"))
    final = best(sweep(scored, label), label).select(label, F.col("threshold").alias("_best"))
    rows = support.join(at, label, "left").join(plain, label, "left").join(final, label, "left")
    few = F.col("support") < min_support
    lost = F.coalesce(F.col("_f_fit"), F.lit(0.0)) <= F.coalesce(F.col("_f_default"), F.lit(0.0))
    return rows.select(
        label, F.when(few | lost, C.DEFAULT_THRESHOLD).otherwise(F.col("_best")).alias("threshold"),
        F.when(few, F.format_string("only %d validation positives", "support")).when(lost, "did not generalize within validation")
        .otherwise("fitted on validation").alias("reason"), "support",
    )


def obfuscate(text: Column, row_id: Column, seed: int = C.SPLIT_SEED) -> Column:
    """The text as an evasive writer would put it: of the words 30 % with digits for letters, 20 % with a dot
    inside, 15 % with a letter doubled; ş as w."""

    def attack(w: Column, i: Column) -> Column:
        n = F.length(w)
        place = (F.floor(unit(row_id, i, F.lit("at"), F.lit(seed)) * (n - 1)) + 1).cast("int")

        def cut(at: Column, insert: Column) -> Column:
            letter = F.substring(w, at + 1, F.lit(1))
            return F.concat(F.substring(w, F.lit(1), at), F.when(insert, ".").otherwise(letter), F.substring(w, at + 1, n))

        def changed(roll: Column) -> Column:
            inside = F.get(F.transform(F.array(place), lambda at: cut(at, roll < 0.50)), F.lit(0))
            return F.when(roll < 0.30, F.translate(w, *ATTACK)).when((roll < 0.65) & (n > 3), inside).otherwise(w)

        # A lambda's argument is worked out once: one digest a word, and another where a place is needed.
        out = F.get(F.transform(F.array(unit(row_id, i, F.lit(seed))), changed), F.lit(0))
        return F.translate(out, "şŞ", "wW")

    return F.array_join(F.transform(F.split(text, " "), attack), " ")


def char_noise(word: Column, *key: Column) -> Column:
    """One inner character swapped with the next, deleted or doubled; words under four characters stay."""
    n = F.length(word)
    op = F.floor(unit(*key, F.lit("op")) * 3)
    i = (F.floor(unit(*key, F.lit("i")) * (n - 2)) + 1).cast("int")
    head, c, d = F.substring(word, F.lit(1), i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i + 2, F.lit(1))
    rest = F.substring(word, i + 2, n)
    return (
        F.when(n < 4, word)
        .when(op == 0, F.concat(head, d, c, F.substring(word, i + 3, n)))
        .when(op == 1, F.concat(head, rest))
        .otherwise(F.concat(head, c, c, rest))
    )


def augment(rows: DataFrame, *key: Column) -> DataFrame:
    """rows with noise in text: an inner word dropped in 30 % (of texts with over three words), two neighbours
    swapped in 30 %, noise in 30 % of the words. The key's columns decide what takes the place of chance.

    The steps are columns of their own, so that no array is made again for each of its words.
    """
    u = lambda *k: unit(*key, *[F.lit(x) if isinstance(x, str) else x for x in k])
    n, m, swap = F.size("_words"), F.size("_left"), F.col("_swap")
    out = rows.withColumn("_words", F.split("text", " "))
    out = out.withColumn("_drop", F.when((n > 3) & (u("drop") < 0.3), F.floor(u("drop at") * (n - 2)) + 1).otherwise(F.lit(-1)))
    out = out.withColumn("_left", F.filter("_words", lambda w, i: i != F.col("_drop")))
    out = out.withColumn("_swap", F.when((m > 1) & (u("swap") < 0.3), F.floor(u("swap at") * (m - 1))).otherwise(F.lit(-5)).cast("int"))
    out = out.withColumn(
        "_moved",
        F.transform("_left", lambda w, i: F.when(i == swap, F.get("_left", i + 1)).when(i == swap + 1, F.get("_left", i - 1)).otherwise(w)),
    )
    noisy = F.transform("_moved", lambda w, i: F.when(u("noise", i) < 0.3, char_noise(w, *key, i)).otherwise(w))
    return out.withColumn("text", F.array_join(noisy, " ")).drop("_words", "_drop", "_left", "_swap", "_moved")


def rare_rows(rows: DataFrame, row_id: str, label: str, target: int = C.AUGMENT_TARGET) -> DataFrame:
    """Copies of the label's positives, drawn with replacement, as many as are missing to the target: draw,
    the row's columns, text with noise. Positives are fewer than the target, else nothing is drawn."""
    positives = rows.where(F.col(label) == 1)
    have = positives.agg(F.count(F.lit(1)).alias("have")).where((F.col("have") > 0) & (F.col("have") < target))
    draws = have.select("have", F.explode(F.sequence(F.lit(1), F.lit(target) - F.col("have"))).alias("draw"))
    draws = draws.withColumn("place", (F.floor(unit(F.lit(label), F.col("draw")) * F.col("have")) + 1).cast("int"))
    # Fewer than `target` rows are numbered.
    few = positives.join(F.broadcast(have.select(F.lit(1).alias("_few")))).drop("_few")
    numbered = few.withColumn("place", F.row_number().over(Window.orderBy(row_id)))
    return augment(draws.join(numbered, "place").drop("place", "have"), F.lit(label), F.col("draw"))


def augmented(rows: DataFrame, row_id: str, labels: list[str], target: int = C.AUGMENT_TARGET) -> DataFrame:
    """The rows themselves (label empty, draw 0) and, for each label that is rarer than the target, its noisy copies."""
    own = rows.select(F.lit("").alias("label"), F.lit(0).alias("draw"), *rows.columns)
    for label in labels:
        more = rare_rows(rows, row_id, label, target).select(F.lit(label).alias("label"), F.col("draw").cast("int").alias("draw"), *rows.columns)
        own = own.unionByName(more)
    return own


def class_report(rows: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """precision, recall, f1 and support of each class, 0 and 1."""
    both = rows.select(predicted.alias("_p"), truth.alias("_t"))
    each = both.select(F.explode(F.array(F.struct(F.lit(1).alias("class"), F.col("_p").alias("p"), F.col("_t").alias("t")), F.struct(F.lit(0).alias("class"), (~F.col("_p")).alias("p"), (~F.col("_t")).alias("t")))).alias("x")).select("x.*")
    out = confusion(each, F.col("p"), F.col("t"), "class")
    return out.select("class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
