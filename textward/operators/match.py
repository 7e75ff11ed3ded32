"""Matching: tokens against the lexicon, with whitelist, suffix fallback and spelled-out words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import has_stem, keys, stem, tokens
from .lexicon import extended

#: Prefix-scoped phrases up to this many are compared as constants; more are joined.
CONSTANT_PREFIXES = 1000
#: Lexicons up to this many entries are broadcast; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 500_000
#: Lexicons up to this many entries are also compared as constants, before tokens become rows.
CONSTANT_ENTRIES = 1000


def candidate_rows(texts: DataFrame, ids: list[str], known: list[str] | None = None) -> DataFrame:
    """ids, is_run, pos, token, key: every token, and every run of letters as letter_runs makes them, from one
    pass over each text. With the lexicon's keys as `known`, of the tokens only those that resolve could find."""
    d = texts.select(*ids, tokens(F.col("text")).alias("_t"), keys(F.col("text")).alias("_k"))
    d = d.withColumn("_one", F.array_compact(F.transform("_k", lambda k, i: F.when(F.length(k) == 1, i))))
    one = F.col("_one")
    first = F.filter(one, lambda x, j: F.coalesce(F.get(one, j - 1) != x - 1, F.lit(True)))
    last = F.filter(one, lambda x, j: F.coalesce(F.get(one, j + 1) != x + 1, F.lit(True)))
    spans = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["b"] - s["a"] >= C.RUN_LENGTH - 1)
    row = lambda run, pos, token, key: F.struct(F.lit(run).alias("is_run"), pos.alias("pos"), token.alias("token"), key.alias("key"))
    part = lambda of, s: F.slice(of, s["a"] + 1, s["b"] - s["a"] + 1)
    runs = F.transform(spans, lambda s: row(True, s["a"], F.array_join(part("_t", s), " "), F.array_join(part("_k", s), "")))
    if known is None:
        plain = F.transform("_k", lambda k, i: row(False, i, F.get("_t", i), k))
    else:
        plain = F.array_compact(F.transform("_k", lambda k, i: F.when(k.isin(known) | has_stem(k), row(False, i, F.get("_t", i), k))))
    return d.select(*ids, F.explode(F.concat(plain, runs)).alias("c")).select(*ids, "c.*")


def letter_runs(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Runs of at least RUN_LENGTH tokens whose keys are single characters, in a row: ids, pos (of the
    first), token (joined by spaces), key (joined, not collapsed again)."""
    single = rows.where(F.length("key") == 1)
    order = Window.partitionBy(*ids).orderBy("pos")
    island = single.withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = island.groupBy(*ids, "island").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "key"))).alias("r"))
    return runs.where(F.size("r") >= C.RUN_LENGTH).select(
        *ids, F.col("r")[0]["pos"].alias("pos"), F.array_join(F.col("r.token"), " ").alias("token"), F.array_join(F.col("r.key"), "").alias("key")
    )


def whitelisted(keys: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Distinct keys of keys(key) that the whitelist shields: by any phrase, or by the beginning of one of
    prefix scope. A curated list is compared as constants in one pass over the keys, and only what it shields is
    made distinct; beyond CONSTANT_PREFIXES phrases the distinct keys are joined."""
    phrases = whitelist.select("NormalizedPhrase", F.col("Scope") == "prefix").distinct().limit(CONSTANT_PREFIXES + 1).collect()
    if len(phrases) <= CONSTANT_PREFIXES:
        safe = F.col("key").isin(sorted({p for p, _ in phrases})) if phrases else F.lit(False)
        for p in sorted(p for p, begins in phrases if begins):
            safe = safe | F.startswith(F.col("key"), F.lit(p))
        return keys.select("key").where((F.col("key") != "") & safe).distinct()
    own = keys.select("key").where("key <> ''").distinct()
    exact = own.join(whitelist.select(F.col("NormalizedPhrase").alias("key")).distinct(), "key", "left_semi")
    return exact.union(extended(own, whitelist)).distinct()


def unshielded(rows: DataFrame, column: str, whitelist: DataFrame) -> DataFrame:
    """rows whose key in a column the whitelist does not shield. A curated list's prefixes are compared as
    constants, so that rows are worked out once; beyond CONSTANT_PREFIXES the shielded keys are joined."""
    prefixes = [r[0] for r in whitelist.where("Scope = 'prefix'").select("NormalizedPhrase").distinct().limit(CONSTANT_PREFIXES + 1).collect()]
    if len(prefixes) > CONSTANT_PREFIXES:
        safe = whitelisted(rows.select(F.col(column).alias("key")), whitelist).withColumnRenamed("key", column)
        return rows.join(safe, column, "left_anti")
    exact = whitelist.select(F.col("NormalizedPhrase").alias(column)).distinct()
    out = rows.join(exact, column, "left_anti")
    for p in sorted(prefixes):
        out = out.where(~F.startswith(F.col(column), F.lit(p)))
    return out


def resolve(rows: DataFrame, lexicon: DataFrame, n_entries: int | None = None) -> DataFrame:
    """rows(key, ...) that the lexicon knows, by key or by one or two suffixes less, with matched and the
    entry's word, category, severity, match_type. The first of the three that is known counts."""
    entry = lexicon.select(
        F.col("NormalizedForm").alias("k"), F.struct(
            F.col("NormalizedForm").alias("matched"), F.col("Word").alias("word"), F.col("Category").alias("category"),
            F.col("Severity").alias("severity"), F.col("MatchType").alias("match_type"),
        ).alias("e"),
    )
    small = (n_entries if n_entries is not None else lexicon.limit(BROADCAST_ENTRIES + 1).count()) <= BROADCAST_ENTRIES
    out = rows.withColumn("_k0", F.col("key")).withColumn("_k1", stem(F.col("key"))).withColumn("_k2", stem(F.col("_k1")))
    for i in range(3):
        side = entry.select(F.col("k").alias(f"_k{i}"), F.col("e").alias(f"_e{i}"))
        out = out.join(F.broadcast(side) if small else side, f"_k{i}", "left")
    e = F.coalesce("_e0", "_e1", "_e2")
    return out.where(e.isNotNull()).withColumn("_e", e).select(*rows.columns, "_e.*")


def scan(texts: DataFrame, ids: list[str], lexicon: DataFrame, whitelist: DataFrame, check_stem: bool = False, n_entries: int | None = None) -> DataFrame:
    """Matches in texts(ids, text): ids, is_run, pos, token, key, matched, word, category, severity, match_type.

    The whitelist is asked for the unstripped key; check_stem asks for the matched one too. n_entries is the
    lexicon's size, where the store knows it; else it is counted.
    """
    known = None
    if n_entries is not None and n_entries <= CONSTANT_ENTRIES:
        known = sorted({r[0] for r in lexicon.select("NormalizedForm").limit(CONSTANT_ENTRIES + 1).collect() if r[0] is not None})
        known = known if len(known) <= CONSTANT_ENTRIES else None  # the store was mistaken
    found = resolve(candidate_rows(texts, ids, known).where("key <> ''"), lexicon, n_entries)
    found = unshielded(found, "key", whitelist)
    if check_stem:
        found = unshielded(found, "matched", whitelist)
    return found.select(*ids, "is_run", "pos", "token", "key", "matched", "word", "category", "severity", "match_type")


def summarise(matches: DataFrame, ids: list[str]) -> DataFrame:
    """One row per matched text: n_matches, max_severity, categories, words, block_words, matches."""
    each = F.struct("is_run", "pos", "token", "word", "category", "severity")
    return matches.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("n_matches"), F.max("severity").alias("max_severity"),
        F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("word")).alias("words"),
        F.array_sort(F.collect_set(F.when(F.col("severity") >= C.BLOCK_SEVERITY, F.col("word")))).alias("block_words"),
        F.sort_array(F.collect_list(each)).alias("matches"),
    )


def check(
    texts: DataFrame, ids: list[str], lexicon: DataFrame, whitelist: DataFrame, n_entries: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Every text: ids, text, is_flagged, n_matches, max_severity, categories, words, block_words, matches.

    source, where given, is scanned in place of texts: the same ids and text by a shorter plan, where texts carry
    columns that were joined to them.
    """
    found = summarise(scan(texts if source is None else source, ids, lexicon, whitelist, n_entries=n_entries), ids)
    none = F.array().cast("array<string>")
    return texts.join(found, ids, "left").select(
        *texts.columns, F.col("n_matches").isNotNull().alias("is_flagged"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("max_severity", F.lit(0)).alias("max_severity"), F.coalesce("categories", none).alias("categories"),
        F.coalesce("words", none).alias("words"), F.coalesce("block_words", none).alias("block_words"), "matches",
    )
