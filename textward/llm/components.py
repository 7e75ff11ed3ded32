"""Connected components of a link table, as DataFrame rounds.

Large-star and small-star rounds alternate until nothing changes; each round
joins edges to the per-node minimum (a partial aggregate), so a node with very
many links is never gathered in one place. Every round is staged in the shared
folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a")
    moved = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links(a, b): any links between long ids, either way round, repeats and loops allowed.

    Returns (node, component): each node that has a link to another node, with
    the smallest id reachable from it. No links give an empty table; a null id
    is ignored.
    """
    now = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _print(now)
    while seen[0]:
        after = stage(_small_star(_large_star(now)), "edges")
        print_ = _print(after)
        drop_staged(now)
        now = after
        if print_ == seen:
            break
        seen = print_
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
