"""Mixing sources to target weights by iterative proportional fitting, native.

Tokens are added up per cell (source, language, topic). The cells' weights are
raked: in turn, the cells of each source, language and topic are scaled until
their sum meets its target, over and over until all three marginals hold. The
ratio of a cell's fitted to its observed tokens, over the largest such ratio,
is the probability with which each of its documents is sampled, so the sample's
expected token shares are the fitted ones and no document comes twice.

One rare source or language has a large ratio and so makes everyone's chance
small. Where `least_share` is given, at least that share of all tokens is
expected in the sample: if the largest ratio leaves less, the ratios are
divided by a smaller number, worked out so that the share is met with no chance
over 1. Cells at 1 are kept whole and stay under their target (sample_cells
names them); all others keep the fitted proportions to each other.

Targets not given are tempered shares: share ** power, made to sum to 1.

Defined cases: a null source or language is the value "(none)"; a
null text has no tokens and topic "notes"; a cell without tokens keeps ratio 1;
the chance of a document comes from a hash of its doc_id (of its text where
that is null), so rows that repeat a doc_id are sampled together; an empty
table gives an empty table; extra columns are ignored, or carried by sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, need, stage, whole, words

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.8, "lang": 0.8, "topic": 1.0}
SWEEPS, MOST_ROUNDS, TOLERANCE, SEED = 5, 8, 1e-9, "17"
#: Cells up to this many are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 20_000


def topic_of(text: Column, n_tokens: Column) -> Column:
    """Kind of text: tables, notes (under 50 tokens), essays (800 and more), or articles."""
    bars = F.length(whole(text)) - F.length(F.replace(whole(text), F.lit("|"), F.lit("")))
    return F.when(bars >= 4, "tables").when(n_tokens < 50, "notes").when(n_tokens >= 800, "essays").otherwise("articles")


def chance(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that doc_id decides."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.md5(whole(text))), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _described(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("n_tokens", F.size(words(F.col("text"))).cast("long"))
    return d.withColumns(
        {"topic": topic_of(F.col("text"), F.col("n_tokens")), "source": F.coalesce("source", F.lit("(none)")), "lang": F.coalesce("lang", F.lit("(none)"))}
    )


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] = POWERS) -> DataFrame:
    """cells(source, lang, topic, tokens) plus ratio: fitted over observed tokens, and residual: what the marginal
    that is furthest off still misses its target by, as a share of all tokens (over TOLERANCE if the sweeps ended
    first, as they do where no weights can meet all targets)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumns({"ratio": F.lit(1.0), "residual": F.lit(0.0)})
    now = cells.where("tokens > 0").withColumn("w", F.col("tokens") / F.lit(float(total)))
    for d in DIMENSIONS:
        if targets and d in targets:
            t = F.lit(0.0)
            for value, share in targets[d].items():
                t = F.when(F.col(d) == value, F.lit(float(share))).otherwise(t)
            now = now.withColumn(f"t_{d}", t)
            continue
        shares = cells.where("tokens > 0").groupBy(d).agg((F.sum("tokens") / F.lit(float(total))).alias("s"))
        norm = shares.agg(F.sum(F.pow("s", F.lit(powers[d])))).first()[0]
        now = now.withColumn(f"t_{d}", F.pow(F.sum("w").over(Window.partitionBy(d)), F.lit(powers[d])) / F.lit(norm))
    for _ in range(MOST_ROUNDS):
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                now = now.withColumn("w", F.col("w") * F.col(f"t_{d}") / F.sum("w").over(Window.partitionBy(d)))
        now = stage(now, "raked")
        off = [now.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"t_{d}")).alias("off")).agg(F.max("off")).first()[0] for d in DIMENSIONS]
        if max(off) <= TOLERANCE:
            break
    fitted = now.select(*DIMENSIONS, (F.col("w") * F.lit(float(total)) / F.col("tokens")).alias("ratio"))
    return cells.join(fitted, list(DIMENSIONS), "left").withColumns({"ratio": F.coalesce("ratio", F.lit(1.0)), "residual": F.lit(float(max(off)))})


def _divisor(raked: DataFrame, most: float, least_share: float) -> float:
    """The largest number, at most `most`, that the ratios may be divided by for a sample of least_share of the tokens."""
    by = most
    while True:
        # Each round caps the cells whose chance would pass 1 and deals what is missing over the others.
        capped, fitted = F.col("ratio") >= by, F.col("tokens") * F.col("ratio")
        total, whole_cells, others = raked.where("tokens > 0").agg(
            F.sum("tokens"), F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(fitted))
        ).first()
        missing = least_share * total - whole_cells
        if missing <= 0 or not others or others / missing >= by:
            return by
        by = others / missing


def _ratios(described: DataFrame, targets, powers, least_share: float) -> tuple[DataFrame, int]:
    """(source, lang, topic, tokens, weight, residual, probability) of the cells, and their count."""
    if not 0 <= least_share <= 1:
        raise ValueError(f"least_share must be from 0 to 1: {least_share}")
    cells = stage(described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = stage(rake(cells, targets, powers), "ratios")
    n, most = raked.agg(F.count(F.lit(1)), F.max(F.when(F.col("tokens") > 0, F.col("ratio")))).first()
    by = _divisor(raked, most, least_share) if most and least_share else most or 1.0
    probability = F.least(F.lit(1.0), F.col("ratio") / F.lit(by))
    return raked.select(*DIMENSIONS, "tokens", F.col("ratio").alias("weight"), "residual", probability.alias("probability")), n


def _probabilities(described: DataFrame, targets, powers, least_share: float) -> DataFrame:
    """described plus weight (the cell's ratio) and probability."""
    ratios, n = _ratios(described, targets, powers, least_share)
    ratios = ratios.drop("tokens", "residual")
    return described.join(F.broadcast(ratios) if n <= BROADCAST_CELLS else ratios, list(DIMENSIONS))


def sample_cells(docs: DataFrame, targets=None, powers: dict[str, float] = POWERS, least_share: float = 0.0) -> DataFrame:
    """source, lang, topic, tokens, weight, residual, probability, capped of each cell; residual: see rake; capped:
    its chance would pass 1."""
    d = _described(need(docs, "doc_id", "text", "source", "lang"))
    cells, _ = _ratios(d, targets, powers, least_share)
    # Uncapped cells share one quotient of probability and weight; a capped one has a smaller.
    by = cells.where("tokens > 0").agg(F.max(F.col("probability") / F.col("weight"))).first()[0] or 1.0
    return cells.withColumn("capped", F.col("weight") * F.lit(by) > 1 + 1e-9)


def mix_report(docs: DataFrame, targets=None, powers: dict[str, float] = POWERS, least_share: float = 0.0) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept of each document."""
    d = _described(need(docs, "doc_id", "text", "source", "lang"))
    d = d.select("doc_id", "source", "lang", "topic", "n_tokens", chance(F.col("doc_id"), F.col("text")).alias("chance"))
    d = _probabilities(stage(d, "described"), targets, powers, least_share)
    return d.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), (F.col("chance") < F.col("probability")).alias("kept"),
    )


def sample(docs: DataFrame, targets=None, powers: dict[str, float] = POWERS, least_share: float = 0.0) -> DataFrame:
    """The sampled documents, with the columns of docs."""
    safe, names = carried(docs, "doc_id", "text", "source", "lang")
    own = safe.withColumns({"__source": F.col("source"), "__lang": F.col("lang")})
    d = _probabilities(_described(own), targets, powers, least_share).where(chance(F.col("doc_id"), F.col("text")) < F.col("probability"))
    back = {"source": "__source", "lang": "__lang"}
    return d.select(*[F.col(back.get(n, n)) for n in names]).toDF(*docs.columns)


def _mix_sql(sweeps: int = SWEEPS * 3) -> str:
    steps, last = [], "w0"
    for k in range(sweeps):
        for d in DIMENSIONS:
            now = f"w{k}_{d}"
            steps.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
            last = now
    targets = ", ".join(
        f"pow(sum(w) OVER (PARTITION BY {d}), {POWERS[d]}) / (SELECT sum(pow(s, {POWERS[d]})) FROM (SELECT sum(w) AS s FROM b GROUP BY {d})) AS t_{d}"
        for d in DIMENSIONS
    )
    return f"""
WITH t AS (
  SELECT *, coalesce(text, '') AS x, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda y: y <> ''))::BIGINT AS n_tokens FROM documents),
d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, n_tokens,
    CASE WHEN length(x) - length(replace(x, '|', '')) >= 4 THEN 'tables' WHEN n_tokens < 50 THEN 'notes'
      WHEN n_tokens >= 800 THEN 'essays' ELSE 'articles' END AS topic,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(x)) || '|{SEED}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS chance FROM t),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
b AS (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS w FROM c WHERE tokens > 0),
w0 AS (SELECT *, {targets} FROM b),
{', '.join(steps)},
r AS (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(w * (SELECT sum(tokens) FROM c) / c.tokens, 1) AS ratio FROM c LEFT JOIN {last} USING (source, lang, topic)),
p AS (SELECT *, least(1, ratio / (SELECT max(ratio) FROM r WHERE tokens > 0)) AS probability FROM r)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(ratio, 6) AS weight, round(probability, 6) AS probability, chance < probability AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic
"""


MIX_SQL = _mix_sql()
