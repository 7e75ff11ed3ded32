"""Keyword retrieval, and answering gated by moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[" + SPACES + "]+")), "")


def top_chunks(questions: DataFrame, ids: list[str], chunks: DataFrame, chunk_id: str, k: int = 1) -> DataFrame:
    """questions(ids, text) to ids, rank, chunk_id, score: the k chunks that share most distinct words, the
    earlier chunk first among equals; the first chunk, with score 0, where none shares a word.

    Words meet in an equi join and are counted. A question meets a chunk only at the question's rarest words: of its
    n words that any chunk has, in order of rising document frequency, the last s - 1 cannot by themselves bring a
    chunk to a score of s. Chunks are first scored on the rare half of a question's words; where the k-th best of
    these already has as many words in common as the frequent half could give a chunk that has none of the rare
    ones, only the chunks met so far can win, and the frequent words are counted on those alone. The other questions
    meet on all their words. So a word that every chunk has joins only questions that have little else.
    """
    c = chunks.select(chunk_id, F.explode(_words(F.col("text"))).alias("w"))
    held = c.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    q = questions.select(*ids, F.explode(_words(F.col("text"))).alias("w")).join(held, "w")
    rarest = F.sort_array(F.collect_list(F.struct("df", "w")))
    q = q.groupBy(*ids).agg(rarest.alias("ws")).withColumn("half", F.ceil(F.size("ws") / 2).cast("int"))
    met = q.select(*ids, F.explode(F.slice("ws", F.lit(1), F.col("half"))["w"]).alias("w")).join(c, "w")
    met = met.groupBy(*ids, chunk_id).agg(F.count(F.lit(1)).alias("rare"))
    # The k-th best score on the rare half, 0 if fewer chunks were met.
    best = met.groupBy(*ids).agg(F.slice(F.sort_array(F.collect_list("rare"), False), 1, k).alias("r"))
    judged = q.join(best, ids, "left").withColumn("kth", F.coalesce(F.get("r", F.lit(k - 1)), F.lit(0)))
    # A chunk met on frequent words alone scores at most their number; it must not even tie.
    settled = judged.withColumn("settled", F.col("kth") > F.size("ws") - F.col("half")).select(*ids, "ws", "half", "settled")
    rest = settled.where("settled").select(*ids, F.explode(F.slice("ws", F.col("half") + 1, F.size("ws"))["w"]).alias("w"))
    texts = chunks.select(chunk_id, _words(F.col("text")).alias("cw"))
    more = met.join(settled.where("settled").select(*ids, F.slice("ws", F.col("half") + 1, F.size("ws"))["w"].alias("fw")), ids).join(texts, chunk_id)
    few = more.select(*ids, chunk_id, (F.col("rare") + F.size(F.array_intersect("fw", "cw"))).alias("score"))
    open_ = settled.where("not settled").select(*ids, F.explode(F.col("ws")["w"]).alias("w")).join(c, "w")
    scores = few.unionByName(open_.groupBy(*ids, chunk_id).agg(F.count(F.lit(1)).alias("score")))
    order = Window.partitionBy(*ids).orderBy(F.desc("score"), chunk_id)
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = chunks.agg(F.min(chunk_id).alias("_first"))
    return (
        questions.select(*ids).join(top, ids, "left").join(F.broadcast(first))  # one row
        .select(*ids, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce(chunk_id, "_first").alias(chunk_id), F.coalesce("score", F.lit(0)).alias("score"))
    )


#: What a model is asked, with places for the chunk and the question, and what is said where it is not asked.
PROMPT = "Use nothing but this passage to reply.\n---\n{chunk}\n---\nQ: {question}\nA:"
BLOCKED, HELD = "This message cannot be answered under the rules of use.", "This message waits for a person to look at it."


def answer(
    answered: DataFrame, ids: list[str], chunks: DataFrame, chunk_id: str, prompt: str = PROMPT, blocked: str = BLOCKED, held: str = HELD
) -> DataFrame:
    """Decided questions (text, proceed, outcome) to ids, answered, outcome, chunk_id, message: a prompt over
    the best chunk for those that may proceed, a notice for the others. The prompt holds {chunk}, then {question}."""
    best = top_chunks(answered.where("proceed"), ids, chunks, chunk_id).select(*ids, chunk_id)
    texts = chunks.select(chunk_id, F.col("text").alias("_chunk"))
    rows = answered.select(*ids, "text", "proceed", "outcome").join(best, ids, "left").join(texts, chunk_id, "left")
    first, rest = prompt.split("{chunk}")
    middle, last = rest.split("{question}")
    prompt = F.concat(F.lit(first), "_chunk", F.lit(middle), "text", F.lit(last))
    notice = F.when(F.col("outcome") == "blocked", blocked).otherwise(held)
    return rows.select(*ids, F.col("proceed").alias("answered"), "outcome", chunk_id, F.when(F.col("proceed"), prompt).otherwise(notice).alias("message"))


def post_comments(decided: DataFrame, *ids: str) -> DataFrame:
    """Decided comments to ids, published, outcome: comments are public, so reviewed ones are held."""
    from .gate import apply_policy

    out = apply_policy(decided, F.lit("public"))
    return out.select(*ids, F.col("proceed").alias("published"), "outcome")
