"""Lexicon building: from curated roots and corpus counts to base words, variations and the lookup.

A root's candidate forms come from four generators. Forms are claimed in order
of root, then of generator; a root whose own key an earlier root has claimed is
dropped with all its forms. Which roots stay depends only on root-to-root links
among candidates, a table no larger than the curated list, and is settled
first; every form is then claimed at once by a rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import normalise

SOURCES = {"base": 0, "mined": 1, "inflect": 2, "leet": 3, "rule": 4, "manual": 5}


def build_whitelist(rows: DataFrame) -> DataFrame:
    """Phrase, NormalizedPhrase, Scope, Reason; a scope other than exact or prefix is an error, as is an
    empty key."""
    scope = F.trim(F.when(F.coalesce("Scope", F.lit("")) == "", "exact").otherwise(F.col("Scope")))
    key = normalise(F.col("Phrase"))
    return rows.select(
        "Phrase",
        F.when(key != "", key).otherwise(F.raise_error(F.concat(F.lit("empty whitelist key: "), F.col("Phrase")))).alias("NormalizedPhrase"),
        F.when(scope.isin("exact", "prefix"), scope).otherwise(F.raise_error(F.concat(F.lit("bad Scope: "), scope))).alias("Scope"),
        "Reason",
    )


def extended(keys: DataFrame, whitelist: DataFrame, longer_than: Column | None = None) -> DataFrame:
    """Rows of keys(key, ...) whose key begins with a prefix-scoped phrase (longer than a given length).

    Of each key as many beginnings are looked up as the phrases have different lengths, an equi join; a startswith
    condition would be a nested loop, and a key's every beginning grows with the square of its length.
    """
    safe = whitelist.where("Scope = 'prefix'").select(F.col("NormalizedPhrase").alias("_begin")).distinct()
    lengths = sorted(r[0] for r in safe.select(F.length("_begin")).distinct().collect())  # lengths of curated phrases
    if not lengths:
        return keys.where(F.lit(False))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("key"))
    starts = F.transform(fitting, lambda n: F.substring(F.col("key"), F.lit(1), n))
    rows = keys.where("key <> ''").withColumn("_begin", F.explode(starts)).join(safe, "_begin")
    if longer_than is not None:
        rows = rows.where(F.length("_begin") > longer_than)
    return rows.drop("_begin").distinct()


def unblocked(forms: DataFrame, whitelist: DataFrame) -> DataFrame:
    """forms(root_key, form, ...) that may belong to their root."""
    exact = whitelist.select(F.col("NormalizedPhrase").alias("form")).distinct()
    pairs = forms.select("root_key", F.col("form").alias("key")).distinct()
    shielded = extended(pairs, whitelist, F.length("root_key")).withColumnRenamed("key", "form")
    return forms.join(exact, "form", "left_anti").join(shielded, ["root_key", "form"], "left_anti")


def unclean(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """forms less those that clean text has at least as often as toxic text (and at all)."""
    known = counts.select(F.col("key").alias("form"), "toxic_count", "clean_count")
    clean, toxic = F.coalesce("clean_count", F.lit(0)), F.coalesce("toxic_count", F.lit(0))
    joined = forms.join(known, "form", "left")
    return joined.where(clean < F.greatest(F.lit(C.CLEAN_RATIO), toxic)).drop("toxic_count", "clean_count")


def mined_forms(roots: DataFrame, counts: DataFrame) -> DataFrame:
    """Corpus keys that extend a root by at most MAX_SUFFIX characters, seen often enough."""
    keys = counts.where(F.col("toxic_count") + F.col("clean_count") >= C.MIN_MINED).where(F.length("key") > 1)
    n = F.length("key")
    begins = F.transform(F.sequence(F.greatest(F.lit(1), n - C.MAX_SUFFIX), n - 1), lambda k: F.substring(F.col("key"), F.lit(1), k))
    rows = keys.select(F.col("key").alias("form"), F.explode(begins).alias("root_key"))
    return rows.join(roots, "root_key").select("Id", "root_key", "form", F.lit("mined").alias("source"), F.lit(0).alias("place"))


def inflected_forms(roots: DataFrame) -> DataFrame:
    suffixes = F.array(*[F.lit(s) for s in C.INFLECTIONS])
    rows = roots.select("Id", "root_key", F.posexplode(suffixes).alias("place", "suffix"))
    return rows.select("Id", "root_key", normalise(F.concat("root_key", "suffix")).alias("form"), F.lit("inflect").alias("source"), "place")


def rule_forms(roots: DataFrame) -> DataFrame:
    """One consonant for another, everywhere or at its first place only; a final k as y."""
    key, s = F.col("root_key"), F.col("swap")
    swaps = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in C.SWAPS])
    rows = roots.select("Id", "root_key", F.posexplode(swaps).alias("n", "swap"))
    rows = rows.withColumn("at", F.instr(key, s["src"])).where("at > 0")
    first = F.concat(F.substring(key, F.lit(1), F.col("at") - 1), s["dst"], F.substring(key, F.col("at") + 1, F.length(key)))
    both = F.array(F.replace(key, s["src"], s["dst"]), first)
    rows = rows.select("Id", "root_key", "n", F.posexplode(both).alias("k", "raw"))
    final = roots.where(key.endswith("k")).select("Id", "root_key", F.lit(1000).alias("n"), F.lit(0).alias("k"), F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("y")).alias("raw"))
    made = rows.unionByName(final).withColumn("form", normalise(F.col("raw")))
    kept = made.where((F.col("n") == 1000) | ((F.col("form") != "") & (F.col("form") != key)))
    return kept.select("Id", "root_key", "form", F.lit("rule").alias("source"), (F.col("n") * 2 + F.col("k")).alias("place"))


def leet_forms(roots: DataFrame) -> DataFrame:
    """Digit spellings: subsets of the letters that digits can stand for, small ones first, at most LEET_CAP,
    each with a letter left. Id, root_key, spelling, place."""
    key, letters = F.col("root_key"), "".join(C.LEET)
    present = F.filter(F.array(*[F.lit(c) for c in letters]), lambda c: F.contains(key, c))
    rows = roots.select("Id", "root_key", present.alias("present")).where(F.size("present") > 0)
    k = F.size("present")
    rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), k).cast("int") - 1)))
    # The first present letter is the mask's highest bit, so falling masks of one size are the combinations in order.
    chosen = F.array_join(
        F.filter(F.col("present"), lambda c, i: F.expr("mask").bitwiseAND(F.pow(F.lit(2), k - 1 - i).cast("int")) != 0), ""
    )
    rows = rows.withColumn("chosen", chosen)
    rows = rows.withColumn("spelling", F.expr(f"translate(root_key, chosen, translate(chosen, '{letters}', '{''.join(C.LEET.values())}'))"))
    rows = rows.where(F.col("spelling").rlike("[a-z]"))
    order = Window.partitionBy("Id").orderBy(F.bit_count("mask"), F.desc("mask"))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= C.LEET_CAP)
    alone = Window.partitionBy("spelling").orderBy("Id")
    return rows.withColumn("n", F.row_number().over(alone)).where("n = 1").select("Id", "root_key", "spelling", "place")


def keyed(roots: DataFrame) -> DataFrame:
    return roots.withColumn("root_key", normalise(F.col("Word")))


def claims(roots: DataFrame, counts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """All candidate forms that pass the guards: Id, root_key, form, source, place."""
    r = keyed(roots).select("Id", "root_key").where("root_key <> ''")
    made = mined_forms(r, counts).unionByName(inflected_forms(r)).unionByName(rule_forms(r))
    return unclean(unblocked(made, whitelist), counts).select("Id", "root_key", "form", "source", "place")


def kept_roots(roots: DataFrame, claimed: DataFrame) -> list[int]:
    """Ids of the roots that no kept earlier root has claimed, in order. Works on the curated list alone."""
    r = keyed(roots).select("Id", "root_key")
    own = r.select(F.col("Id").alias("later"), F.col("root_key").alias("form"))
    by_form = claimed.select("Id", "form").join(own, "form").where("Id < later")
    by_key = r.select("Id", F.col("root_key").alias("form")).join(own, "form").where("Id < later")
    links: dict[int, set[int]] = {}
    for e in by_form.select("Id", "later").unionByName(by_key.select("Id", "later")).distinct().collect():
        links.setdefault(e["later"], set()).add(e["Id"])
    kept: list[int] = []
    for i in sorted(x["Id"] for x in r.where("root_key <> ''").select("Id").collect()):
        if not links.get(i, set()) & set(kept):
            kept.append(i)
    return kept


def build(roots: DataFrame, manual: DataFrame, whitelist: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base words, variations) with the columns of the store's tables."""
    claimed = claims(roots, counts, whitelist).persist()  # read twice; the curated list bounds it
    stay = kept_roots(roots, claimed)
    r = keyed(roots).where(F.col("Id").isin(stay) if stay else F.lit(False))
    words = r.select("Id", "Word", F.col("root_key").alias("NormalizedWord"), "Category", "Severity")
    rank = reduce(lambda x, kv: F.when(F.col("source") == kv[0], kv[1]).otherwise(x), SOURCES.items(), F.lit(None))
    base = r.select("Id", "root_key", F.col("root_key").alias("form"), F.lit("base").alias("source"), F.lit(0).alias("place"))
    forms = claimed.join(r.select("Id"), "Id").unionByName(base).withColumn("rank", rank)
    first = Window.partitionBy("form").orderBy("Id", "rank", "place")
    taken = forms.withColumn("n", F.row_number().over(first)).where("n = 1")
    generated = taken.where("source <> 'base'").select(
        F.col("Id").alias("BadWordId"), F.col("form").alias("Variation"), F.col("form").alias("NormalizedVariation"),
        F.col("source").alias("Source"), "place",
    )
    leet = leet_forms(r.select("Id", "root_key")).select(
        F.col("Id").alias("BadWordId"), F.col("spelling").alias("Variation"), F.col("root_key").alias("NormalizedVariation"),
        F.lit("leet").alias("Source"), "place",
    )
    by_hand = manual.select("Position", "Variation", normalise(F.col("Word")).alias("root_key"), normalise(F.col("Variation")).alias("form"))
    by_hand = by_hand.join(r.select("Id", "root_key"), "root_key").where("form <> ''").join(taken.select("form"), "form", "left_anti")
    once = Window.partitionBy("form").orderBy("Position")
    by_hand = by_hand.withColumn("n", F.row_number().over(once)).where("n = 1").select(
        F.col("Id").alias("BadWordId"), "Variation", F.col("form").alias("NormalizedVariation"), F.lit("manual").alias("Source"),
        F.col("Position").alias("place"),
    )
    rows = generated.unionByName(leet).unionByName(by_hand).withColumn("source", F.col("Source")).withColumn("rank", rank)
    # Numbers run on over the words: the place within a word, and the variations of the words before it. Mined forms
    # grow with the vocabulary, words do not.
    rows = rows.withColumn("by_hand", F.col("Source") == "manual")
    own = F.row_number().over(Window.partitionBy("by_hand", "BadWordId").orderBy("rank", "place", "Variation"))
    sizes = rows.groupBy("by_hand", "BadWordId").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("by_hand", "BadWordId"))  # at most two rows a curated word
    before = sizes.select("by_hand", "BadWordId", (upto - F.col("n")).alias("before"))
    numbered = rows.withColumn("own", own).join(before, ["by_hand", "BadWordId"])
    variations = numbered.select(
        (F.col("before") + F.col("own")).cast("int").alias("Id"), "BadWordId", "Variation", "NormalizedVariation", F.col("Source").alias("Source")
    )
    return words, variations


def unmatched_manual(roots: DataFrame, manual: DataFrame) -> DataFrame:
    """Hand-written variations whose word is no root."""
    known = keyed(roots).select("root_key")
    return manual.withColumn("root_key", normalise(F.col("Word"))).join(known, "root_key", "left_anti").drop("root_key")


def lookup(words: DataFrame, variations: DataFrame) -> DataFrame:
    """One entry per key: NormalizedForm, BadWordId, Word, Category, Severity, MatchType; base words win.
    Rows with an IsActive column that is false are left out."""
    active = lambda df: df.where("IsActive") if "IsActive" in df.columns else df
    w = active(words).select(F.col("Id").alias("BadWordId"), "NormalizedWord", "Word", "Category", "Severity")
    base = w.select(F.col("NormalizedWord").alias("NormalizedForm"), "BadWordId", "Word", "Category", "Severity", F.lit("base").alias("MatchType"))
    more = active(variations).select("BadWordId", F.col("NormalizedVariation").alias("NormalizedForm")).join(w, "BadWordId")
    both = base.unionByName(more.select("NormalizedForm", "BadWordId", "Word", "Category", "Severity", F.lit("variation").alias("MatchType")))
    least = F.min(F.struct("MatchType", "BadWordId", "Word", "Category", "Severity")).alias("e")
    return both.groupBy("NormalizedForm").agg(least).select("NormalizedForm", "e.BadWordId", "e.Word", "e.Category", "e.Severity", "e.MatchType")


def violations(words: DataFrame, variations: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows that break a constraint of the store: rule, detail. A sound lexicon gives none."""
    row = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    twice = lambda df, c, rule: row(df.groupBy(c).count().where("count > 1"), rule, F.col(c))
    not_leet = variations.where("Source <> 'leet'")
    parts = [
        row(words.where("Severity is null or Severity not between 1 and 3"), "severity", F.col("Word")),
        row(variations.where(~F.col("Source").isin(list(SOURCES)[1:])), "source", F.col("Variation")),
        row(whitelist.where(~F.col("Scope").isin("exact", "prefix")), "scope", F.col("Phrase")),
        row(whitelist.where("Reason is null or Reason = ''"), "reason", F.col("Phrase")),
        twice(words, "NormalizedWord", "unique word"), twice(variations, "Variation", "unique spelling"),
        twice(not_leet, "NormalizedVariation", "unique key"), twice(whitelist, "NormalizedPhrase", "unique phrase"),
        row(variations.join(words, F.col("BadWordId") == words["Id"], "left_anti"), "orphan", F.col("Variation")),
        row(variations.where(normalise(F.col("Variation")) != F.col("NormalizedVariation")), "normalised", F.col("Variation")),
    ]
    return reduce(DataFrame.unionByName, parts)


def delete_words(words: DataFrame, variations: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the words that `gone` holds for; their variations go too."""
    stay = words.where(~gone)
    return stay, variations.join(stay.select(F.col("Id").alias("BadWordId")), "BadWordId", "left_semi")


def orphans(words: DataFrame, variations: DataFrame) -> DataFrame:
    return variations.join(words.select(F.col("Id").alias("BadWordId")), "BadWordId", "left_anti")


def per_category(words: DataFrame, variations: DataFrame) -> DataFrame:
    """Category, words, variations."""
    v = variations.select(F.col("Id").alias("vid"), "BadWordId")
    joined = words.join(v, words["Id"] == v["BadWordId"], "left")
    return joined.groupBy("Category").agg(F.countDistinct("Id").alias("words"), F.count("vid").alias("variations"))


def most_varied(words: DataFrame, variations: DataFrame) -> DataFrame:
    """The word with the most variations, the first by Id among equals."""
    v = variations.groupBy("BadWordId").agg(F.count(F.lit(1)).alias("variations"))
    return v.join(words, v["BadWordId"] == words["Id"]).orderBy(F.desc("variations"), "Id").limit(1).select("Id", "Word", "variations")


def fresh(spark: SparkSession, words: DataFrame, variations: DataFrame, whitelist: DataFrame) -> None:
    """The three tables and the lookup as temporary views for SQL."""
    words.createOrReplaceTempView("BadWords")
    variations.createOrReplaceTempView("WordVariations")
    whitelist.createOrReplaceTempView("Whitelist")
    lookup(words, variations).createOrReplaceTempView("LexiconLookup")


def drop_stats(roots: DataFrame, counts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Source, dropped: candidate forms of the kept roots that the corpus guard turns away.

    A mined form is judged by the guard first; another only if no earlier root owns the key and it is not blocked.
    """
    stay = kept_roots(roots, claims(roots, counts, whitelist).persist())
    r = keyed(roots).where(F.col("Id").isin(stay) if stay else F.lit(False)).select("Id", "root_key")
    owned = r.select(F.col("Id").alias("owner"), F.col("root_key").alias("form"))
    made = unblocked(inflected_forms(r).unionByName(rule_forms(r)), whitelist)
    taken = made.join(owned, "form").where("owner <= Id").select("Id", "form").distinct()
    judged = mined_forms(r, counts).unionByName(made.join(taken, ["Id", "form"], "left_anti").select("Id", "root_key", "form", "source", "place"))
    known = counts.select(F.col("key").alias("form"), "toxic_count", "clean_count")
    dropped = judged.join(known, "form").where(F.col("clean_count") >= F.greatest(F.lit(C.CLEAN_RATIO), F.col("toxic_count")))
    return dropped.groupBy(F.col("source").alias("Source")).agg(F.count(F.lit(1)).alias("dropped"))
