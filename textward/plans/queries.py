"""The registered queries of the moderation side: each operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import unit
from ..operators import evaluation, features, gate, labels, lexicon, match, mining, retrieval
from ..sources import fixtures, sinks
from ..sources.tables import corpus, requests, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Bias of the linear scorer.
BIAS = -1.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(*names: str) -> list:
    """Array columns as comma-separated text."""
    return [F.array_join(n, ",").alias(n) for n in names]


# --- text and mining -----------------------------------------------------------
@query
def tokens_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.token_rows(table(spark, sf_dir, "documents"), ["doc_id"]).where("key <> ''")


@query
def token_df_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.key_counts(corpus(spark, sf_dir))


@query
def mine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.candidates(corpus(spark, sf_dir), ("quality",))


# --- lexicon --------------------------------------------------------------------
def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts = mining.key_counts(corpus(spark, sf_dir)).persist()
    white = fixtures.whitelist(spark)
    words, variations = lexicon.build(fixtures.roots(spark), fixtures.manual(spark), white, counts)
    return words.persist(), variations.persist(), white


def of_store(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*_store(spark, sf_dir))

    return query(run)


@of_store
def lexicon_words(words, variations, white):
    return words


@of_store
def lexicon_variations(words, variations, white):
    return variations


@of_store
def lexicon_lookup_view(words, variations, white):
    return lexicon.lookup(words, variations)


@of_store
def lexicon_leet_roundtrip(words, variations, white):
    from ..functions.text import normalise

    made = lexicon.leet_forms(words.select("Id", F.col("NormalizedWord").alias("root_key")))
    return made.select("Id", "spelling", "place", (normalise(F.col("spelling")) == F.col("root_key")).alias("returns"))


@of_store
def lexicon_violations(words, variations, white):
    """The constraints asked of a store that breaks each of them: severities, sources, scopes and reasons out of
    range, words, spellings, keys and phrases that come twice, orphans, and keys that are none."""
    s = F.col("Source")
    twice = words.where("Category = 'threat'").withColumn("Id", F.col("Id") + 1000)
    words = words.union(twice).withColumn("Severity", F.when(F.col("Category") == "obscene", 4).otherwise(F.col("Severity")))
    variations = variations.union(variations.where("Source = 'inflect' and BadWordId = 1"))
    variations = variations.withColumns({
        "Source": F.when(s == "rule", "typo").otherwise(s), "BadWordId": F.when(s == "manual", F.col("BadWordId") + 5000).otherwise(F.col("BadWordId")),
        "NormalizedVariation": F.when(s == "leet", F.col("Variation")).otherwise(F.col("NormalizedVariation")),
    })
    white = white.union(white.where("Phrase = 'the'"))
    white = white.withColumns({
        "Reason": F.when(F.col("Scope") == "exact", "").otherwise(F.col("Reason")), "Scope": F.when(F.col("Scope") == "prefix", "suffix").otherwise(F.col("Scope")),
    })
    return lexicon.violations(words, variations, white)


@of_store
def lexicon_orphans(words, variations, white):
    """What a delete without cascade would leave behind."""
    return lexicon.orphans(words.where("Category <> 'obscene'"), variations).select("Variation", "Source")


@of_store
def lexicon_delete_cascade(words, variations, white):
    w, v = lexicon.delete_words(words, variations, F.col("Category") == "obscene")
    return w.agg(F.count(F.lit(1)).alias("words")).join(v.agg(F.count(F.lit(1)).alias("variations")))


@of_store
def variations_per_category(words, variations, white):
    return lexicon.per_category(words, variations)


@of_store
def variations_by_source(words, variations, white):
    return variations.groupBy("Source").agg(F.count(F.lit(1)).alias("n"))


@of_store
def word_with_most_variations(words, variations, white):
    return lexicon.most_varied(words, variations)


@of_store
def lexicon_point_lookup(words, variations, white):
    return lexicon.lookup(words, variations).where("NormalizedForm = 'loserler'").select("NormalizedForm", "Word", "MatchType")


@of_store
def seed_sql(words, variations, white):
    return sinks.seed_script(words, variations, white)


@query
def lexicon_drop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mining.key_counts(corpus(spark, sf_dir)).persist()
    return lexicon.drop_stats(fixtures.roots(spark), counts, fixtures.whitelist(spark))


@query
def manual_without_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unmatched_manual(fixtures.roots(spark), fixtures.manual(spark))


# --- matching -------------------------------------------------------------------
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return match.scan(docs, ["doc_id"], fixtures.small_lexicon(spark), fixtures.whitelist(spark), n_entries=fixtures.N_SMALL).drop("match_type")


@query
def whitelist_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.whitelisted(mining.document_keys(table(spark, sf_dir, "documents").select("text")), fixtures.whitelist(spark))


@query
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = fixtures.small_lexicon(spark).select(F.col("NormalizedForm").alias("key"), F.col("Word").alias("word"), F.col("Category").alias("category"), F.col("Severity").alias("severity"))
    return mining.token_rows(table(spark, sf_dir, "documents"), ["doc_id"]).join(F.broadcast(entry), "key")


@query
def match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)


@query
def match_suffix_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).where("key <> matched").groupBy("key", "matched").agg(F.count(F.lit(1)).alias("n"))


@query
def letter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.letter_runs(mining.token_rows(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


@query
def doc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = match.check(docs, ["doc_id"], fixtures.small_lexicon(spark), fixtures.whitelist(spark), n_entries=fixtures.N_SMALL)
    return out.select("doc_id", "is_flagged", "n_matches", "max_severity", *joined("categories", "words"))


# --- gate -----------------------------------------------------------------------
def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = match.check(requests(spark, sf_dir), ["conv_id", "turn"], fixtures.small_lexicon(spark), fixtures.whitelist(spark), n_entries=fixtures.N_SMALL)
    return gate.decide(checked, None)


@query
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("conv_id", "turn", "action", "max_severity", "n_matches", *joined("categories", "words"))


def _key_sums(docs: DataFrame) -> DataFrame:
    weights = mining.candidates(docs).select(F.col("Candidate").alias("key"), F.col("LogOdds").alias("weight"))
    return evaluation.key_sums(docs, ["doc_id"], weights)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return evaluation.linear_scores(docs, ["doc_id"], None, BIAS, _key_sums(docs))


def _scored_check(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """Documents with scores, checked; their texts are scanned without the scores."""
    scored = evaluation.linear_scores(docs, ["doc_id"], None, BIAS, sums)
    return match.check(scored, ["doc_id"], fixtures.small_lexicon(docs.sparkSession), fixtures.whitelist(docs.sparkSession), fixtures.N_SMALL, docs)


@query
def gate_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return gate.decide(_scored_check(docs, _key_sums(docs))).select("doc_id", "toxicity_score", "action")


@query
def policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.apply_policy(_decided(spark, sf_dir)).groupBy("surface", "action", "outcome", "proceed").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = gate.audit(gate.apply_policy(_decided(spark, sf_dir)), "conv_id", "turn")
    return entries.select("conv_id", "turn", "surface", "context", "action", "outcome", *joined("matched_words"), "text")


@query
def moderation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


#: Bias of each label's own scorer.
BIASES = {"insult": -1.0, "threat": -2.0, "obscene": -0.5, "severe_toxicity": 1.0, "toxicity": -1.0}


def _category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, score: each label's own score."""
    docs = corpus(spark, sf_dir)
    return evaluation.label_scores(docs, ["doc_id"], None, BIASES, _key_sums(docs))


@query
def category_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.flag_categories(_category_scores(spark, sf_dir), ["doc_id"])


@query
def invalid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as requests: every seventh without its text, every fourth with its source as surface (others
    private, public or none), every fifth with the text's beginning as context."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    surface = F.when(i % 4 == 0, "private").when(i % 4 == 1, "public").when(i % 4 == 3, F.col("source"))
    sent = d.select("doc_id", F.when(i % 7 != 0, F.col("text")).alias("text"), surface.alias("surface"), F.when(i % 5 == 0, F.substring("text", 1, 300)).alias("context"))
    return gate.split_requests(sent)[1].select("doc_id", "why")


@query
def oversized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent in batches of a language and an odd or even number."""
    return gate.oversized_batches(table(spark, sf_dir, "documents").withColumn("batch", F.concat_ws("-", "lang", F.col("doc_id") % 2)), "batch")


@query
def service_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service answers to labelled documents sent in public, with the categories that it reports."""
    docs = corpus(spark, sf_dir)
    sums = _key_sums(docs)
    scores = evaluation.label_scores(docs, ["doc_id"], None, BIASES, sums)
    flagged = gate.category_maps(gate.flag_categories(scores, ["doc_id"]), ["doc_id"])
    answered = gate.apply_policy(gate.decide(_scored_check(docs, sums)), F.lit("public")).join(flagged, "doc_id", "left")
    out = gate.response(answered, "doc_id")
    told = F.transform(F.map_entries("flagged_categories"), lambda e: F.concat_ws("=", e["key"], F.format_number(e["value"], 3)))
    return out.select(
        "doc_id", "action", "proceed", "outcome", "toxicity_score", "lexicon_severity", F.size("lexicon_matches").alias("n_matches"),
        F.array_join(told, ",").alias("flagged"), *joined("advisory_categories"),
    )


@query
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.health(fixtures.small_lexicon(spark), False).drop("loaded_at")


@query
def gated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.post_comments(_decided(spark, sf_dir).drop("surface"), "conv_id", "turn")


# --- labels ---------------------------------------------------------------------
def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as three annotators might have had them: two near copies of each, with 30 % of their
    labels turned."""
    docs, k = corpus(spark, sf_dir), F.col("k")
    copies = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    turned = lambda c: F.when(unit(F.col("doc_id"), k, F.lit(c)) < 0.3, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    copies = copies.select((F.col("doc_id") + k * 10_000_000_000).alias("doc_id"), F.concat("text", F.lit(" !")).alias("text"), turned("toxic"), turned("quality"))
    return docs.select("doc_id", "text", "toxic", "quality").union(copies)


@query
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.vote_groups(_annotated(spark, sf_dir), ["toxic", "quality"])


@query
def label_vote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.vote(_annotated(spark, sf_dir), ["toxic", "quality"]).drop("text")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.split(corpus(spark, sf_dir)).select("doc_id", "split")


@query
def split_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.positive_rates(labels.split(corpus(spark, sf_dir)))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return match.check(labels.split(docs).drop("near_key"), ["doc_id"], fixtures.small_lexicon(spark), fixtures.whitelist(spark), fixtures.N_SMALL, docs)


@query
def label_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.review_queue(_checked(spark, sf_dir))


@query
def label_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.queue_counts(labels.review_queue(_checked(spark, sf_dir)))


@query
def train_relabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.relabel(_checked(spark, sf_dir), categories={"insult": "quality"}).select("doc_id", "toxic", "quality", "repaired")


# --- evaluation -----------------------------------------------------------------
@query
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = match.check(corpus(spark, sf_dir), ["doc_id"], fixtures.small_lexicon(spark), fixtures.whitelist(spark), n_entries=fixtures.N_SMALL)
    return evaluation.confusion(checked, F.col("is_flagged"), F.col("toxic") == 1)


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_report(_scored(spark, sf_dir), F.col("toxicity_score") >= C.DEFAULT_THRESHOLD, F.col("toxic") == 1)


@query
def signal_or_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return evaluation.confusion(_scored_check(docs, _key_sums(docs)), F.col("is_flagged") | (F.col("toxicity_score") >= 0.5), F.col("toxic") == 1)


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sweep(_scored(spark, sf_dir).select(F.col("toxicity_score").alias("score"), F.col("toxic").alias("truth")))


@query
def threshold_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("truth")) for c in ("toxic", "quality")])
    return evaluation.decide_thresholds(rows.select("doc_id", F.col("toxicity_score").alias("score"), F.explode(each).alias("x")).select("doc_id", "score", "x.*"), "label", "doc_id")


@query
def obfuscation_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lex, white = corpus(spark, sf_dir), fixtures.small_lexicon(spark), fixtures.whitelist(spark)
    before = match.check(docs, ["doc_id"], lex, white, fixtures.N_SMALL).select("doc_id", "toxic", F.col("is_flagged").alias("hit"))
    changed = docs.select("doc_id", evaluation.obfuscate(F.col("text"), F.col("doc_id")).alias("text"))
    after = match.check(changed, ["doc_id"], lex, white, fixtures.N_SMALL).select("doc_id", F.col("is_flagged").alias("hit_after"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    caught = (F.col("toxic") == 1) & F.col("hit")
    return before.join(after, "doc_id").agg(n(caught).alias("caught"), n(caught & F.col("hit_after")).alias("kept"), n(F.col("hit_after")).alias("flagged_after"))


@query
def rare_label_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rare_rows(corpus(spark, sf_dir), "doc_id", "toxic").select("draw", "doc_id")


@query
def augmented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rare_rows(corpus(spark, sf_dir), "doc_id", "toxic").select("draw", "doc_id", "text")


@query
def augmented_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents and the copies of every rare label, by their digests."""
    out = evaluation.augmented(corpus(spark, sf_dir).select("doc_id", "text", "toxic", "quality"), "doc_id", ["toxic", "quality"])
    return out.select("label", "draw", "doc_id", "toxic", "quality", F.md5("text").alias("text_md5"))


# --- features, models, retrieval -------------------------------------------------
@query
def char_ngrams_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.term_counts(table(spark, sf_dir, "benchmark"), ["item_id"], features.char_grams(F.col("text")))


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.tfidf(table(spark, sf_dir, "benchmark"), ["item_id"], features.char_grams(F.col("text")))
    return w.withColumn("weight", F.round("weight", 9))


@query
def word_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of words and pairs of words over the labelled documents."""
    w = features.tfidf(corpus(spark, sf_dir).select("doc_id", "text"), ["doc_id"], features.word_grams(F.col("text")), cap=60_000)
    return w.withColumn("weight", F.round("weight", 9))


@query
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced logistic regression on hashed word grams, trained on train, scored on val and test."""
    rows = features.hashed(labels.split(corpus(spark, sf_dir)).drop("near_key"), features.word_grams(F.col("text"))).persist()
    model = features.logistic(rows.where("split = 'train'"), "toxic")
    scored = features.scores(model, rows.where("split <> 'train'"))
    return evaluation.confusion(scored, F.col("score") >= C.DEFAULT_THRESHOLD, F.col("toxic") == 1, "split")


def _hashed(rows: DataFrame) -> DataFrame:
    return features.hashed(rows, features.word_grams(F.col("text")), 1 << 12)


def _table(spark: SparkSession, names: tuple[str, str], rows: list[tuple]) -> DataFrame:
    from ..sources.tables import literal

    return literal(spark, list(names), rows)


@query
def svm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear SVM with calibrated scores, trained on train, scored on val and test."""
    from pyspark.ml.functions import vector_to_array

    rows = _hashed(labels.split(corpus(spark, sf_dir)).drop("near_key")).persist()
    model, a, b = features.support_vectors(rows.where("split = 'train'"), "toxic", 20)
    margin = vector_to_array(F.col("rawPrediction"))[1]
    scored = model.transform(rows.where("split <> 'train'")).withColumn("score", 1 / (1 + F.exp(-(margin * a + b))))
    return evaluation.confusion(scored, F.col("score") >= C.DEFAULT_THRESHOLD, F.col("toxic") == 1, "split")


@query
def model_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature configurations by macro F1 on val at their best thresholds, best first."""
    rows = labels.split(corpus(spark, sf_dir)).drop("near_key").persist()
    configs = {
        "words": _hashed,
        "characters": lambda df: features.hashed(df, features.char_grams(F.col("text"), 2, 4), 1 << 12),
    }
    found = features.experiments(configs, rows.where("split = 'train'"), rows.where("split = 'val'"), ["toxic"], iterations=25)
    return _table(spark, ("config", "macro_f1"), found)


@query
def repair_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 on val after training on the original and on the repaired train labels."""
    checked = _checked(spark, sf_dir).persist()
    train, val = checked.where("split = 'train'"), checked.where("split = 'val'")
    found = features.compare_repair(train, labels.relabel(checked, categories={"insult": "quality"}), val, ["toxic"], _hashed, iterations=25)
    return _table(spark, ("labels", "macro_f1"), found)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_chunks(_questions(spark, sf_dir), ["conv_id", "turn"], table(spark, sf_dir, "benchmark"), "item_id", 3)


@query
def gated_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = gate.apply_policy(_decided(spark, sf_dir).where("surface = 'private'"))
    return retrieval.answer(answered, ["conv_id", "turn"], table(spark, sf_dir, "benchmark"), "item_id")
