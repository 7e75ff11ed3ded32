"""Moderation of a stream of requests: the batch operators on each micro-batch, and sinks that a retry cannot double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate, match


def answer(requests: DataFrame, lexicon: DataFrame, whitelist: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame]:
    """(answered, rejected) of a batch of requests with request_id, text, surface, context. Without a lexicon
    there is no gate, and that is an error."""
    if lexicon is None or whitelist is None:
        raise RuntimeError("moderation gate not loaded")
    accepted, rejected = gate.split_requests(requests)
    ids = ["request_id"]
    checked = match.check(accepted, ids, lexicon, whitelist)
    score = None
    if scorer is not None:
        own = scorer(accepted.select(*ids, "text")).where("label = 'toxicity'").select(*ids, F.col("score").alias("toxicity_score"))
        checked, score = checked.join(own, ids, "left"), "toxicity_score"
    return gate.apply_policy(gate.decide(checked, score)), rejected


def start(stream: DataFrame, lexicon: DataFrame, whitelist: DataFrame, out: str, checkpoint: str, scorer=None):
    """A running query that writes content, held, audit and rejected under `out`.

    Each micro-batch overwrites the folder of its own number, so a batch that is run again leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        answered, rejected = answer(batch, lexicon, whitelist, scorer)
        answered = answered.persist()
        put = lambda df, name: df.write.mode("overwrite").json(f"{out}/{name}/batch={number}", ignoreNullFields=False)
        put(answered.where("proceed").select("request_id", "text", "surface", "outcome"), "content")
        put(answered.where("outcome = 'held_for_review'").select("request_id", "text", "reason"), "held")
        stamped = gate.audit(answered, "request_id").withColumn("timestamp", F.current_timestamp())
        put(stamped, "audit")
        put(rejected, "rejected")
        answered.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def flagged_rates(answered: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Addition: outcomes per window of event time, late requests up to a limit."""
    return answered.withWatermark(time, late).groupBy(F.window(time, window), "outcome").agg(F.count(F.lit(1)).alias("n"))
