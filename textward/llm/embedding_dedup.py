"""Embedding near-duplicates over an inverted multi-index.

Two independent codebooks, one for each half of the vectors, form a product
grid of cells. A vector lives in the cell of its two nearest centroids, and
visits other cells by multi-sequence traversal: cells come in order of a lower
bound on the distance from the vector to anything that lives there, until the
bound passes a radius. At target_recall 1 the radius is that of the cosine
threshold, so no link can be missed; below 1 it is the radius within which that
share of pairs exactly at the threshold is met, measured by moving sampled
vectors to that cosine in random directions. Closer pairs are met more often.
Every pair that meets is verified in double precision.

A vector carries the list of the cells it visits, worked out once. Cells that
share a first centroid form groups of bounded size; a group is a task, and a
vector is sent to each group once however many of its cells it visits. A group
with many members is cut into chunks, each pair of chunks a task. Tasks hand on
counts and a spanning forest, never pairs. Equal vectors are compared once,
with their number; they are told by two 64-bit digests, so that joins carry no
vectors.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing and is its own component; vectors of different
lengths never link; a null vec_id counts as a vector and is never the smallest;
a component whose ids are all null has a null component_id and no kept row;
rows that repeat a vec_id are vectors of their own; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, need, stage
from .components import components
from .linking import spanning

THRESHOLD, TARGET_RECALL = 0.95, 0.9999
#: Vectors that the codebooks and the radius are fitted on (at least, and for each centroid), wanted members of a
#: cell, most centroids of a half.
SAMPLE, PER_CENTROID, CELL_MEMBERS, MOST_CENTROIDS = 4096, 32, 256, 1024
#: Wanted rows of a group, rows of a group beyond which it is cut into chunks, rows of a block of pairs.
GROUP_ROWS, CHUNK, BLOCK = 16_384, 32_768, 1024
#: Digests of repeated vectors up to this many are broadcast; more are joined by shuffle.
BROADCAST_REPEATS = 200_000


@dataclass
class MultiIndex:
    dim: int
    halves: tuple[np.ndarray, np.ndarray]  # centroids of each half
    between: tuple[np.ndarray, np.ndarray]  # distances between the centroids of a half
    radius: float
    block: np.ndarray  # of each centroid of the second half: cells of one first centroid and one block are a group
    blocks: int

    def cut(self) -> int:
        return (self.dim + 1) // 2

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Nearest centroid of each half, and squared lower bounds on the distance to each centroid's region."""
        near, low = [], []
        for part, c, gap in zip((x[:, : self.cut()], x[:, self.cut() :]), self.halves, self.between):
            d = (part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1)[None]
            n = d.argmin(axis=1)
            over = (d - d[np.arange(len(x)), n][:, None]) / np.where(gap[n] > 0, 2 * gap[n], np.inf)
            near.append(n)
            low.append(np.maximum(over, 0) ** 2)
        return near, low

    def groups(self, cells: np.ndarray) -> np.ndarray:
        k2 = len(self.block)
        return cells // k2 * self.blocks + self.block[cells % k2]


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one from an array of lists, padded with zeros to dim."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(vectors), dim))
    x[np.arange(dim)[None, :] < sizes[:, None]] = values
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centroids(n: int) -> int:
    return int(min(MOST_CENTROIDS, max(2, round((n / CELL_MEMBERS) ** 0.5))))


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((1, 0))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray, n: int, threshold: float, target_recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks and radius from sampled unit vectors x of n."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    k = centroids(n)
    cut = (dim + 1) // 2
    halves = tuple(_codebook(part, k, rng) for part in (x[:, :cut], x[:, cut:]))
    between = tuple(np.sqrt(((c[:, None, :] - c[None]) ** 2).sum(axis=2)) for c in halves)
    full = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    # Second centroids that are near each other share a block: in order along the direction in which they differ most.
    c = halves[1] - halves[1].mean(axis=0)
    along = c @ np.linalg.svd(c, full_matrices=False)[2][0] if c.size else np.zeros(len(c))
    blocks = int(min(len(c), max(1, -(-4 * n // (len(halves[0]) * GROUP_ROWS)))))
    block = np.empty(len(c), np.int64)
    block[np.argsort(along, kind="stable")] = np.arange(len(c)) * blocks // len(c)
    index = MultiIndex(dim, halves, between, full, block, blocks)
    if target_recall < 1 and dim > 1:
        some = x[rng.choice(len(x), min(4000, len(x)), replace=False)]
        away = rng.normal(size=some.shape)
        away -= (away * some).sum(axis=1)[:, None] * some
        away /= np.maximum(np.sqrt((away * away).sum(axis=1)), 1e-300)[:, None]
        moved = threshold * some + np.sqrt(1 - threshold**2) * away
        (a, la), (b, lb) = index.bounds(some), index.bounds(moved)
        i = np.arange(len(some))
        there = la[0][i, b[0]] + la[1][i, b[1]]
        back = lb[0][i, a[0]] + lb[1][i, a[1]]
        index.radius = min(full, float(np.sqrt(np.quantile(np.minimum(there, back), target_recall, method="higher"))) + 1e-9)
    return index


def visited(low1: np.ndarray, low2: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) by increasing low1[i] + low2[j], while that is at most `most`."""
    first, second = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    a, b = low1[first].tolist(), low2[second].tolist()
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap:
        bound, i, j = heappop(heap)
        if bound > most:
            break
        out.append((int(first[i]), int(second[j])))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < len(b):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _sizes(classes: DataFrame, shared) -> dict[int, int]:
    """Rows that each group will get: a number for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        total = np.zeros(len(index.halves[0]) * index.blocks, np.int64)
        order = np.argsort(index.block, kind="stable")
        first = np.searchsorted(index.block[order], np.arange(index.blocks))
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                _, (l1, l2) = index.bounds(unit(batch.column(0).slice(s, 256), index.dim))
                nearest = np.minimum.reduceat(l2[:, order], first, axis=1)
                for b in range(index.blocks):
                    total[b :: index.blocks] += (l1 + nearest[:, b : b + 1] <= index.radius**2).sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["grp", "n"])

    counts = classes.select("embedding").mapInArrow(run, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    return {r["grp"]: r["n"] for r in counts.where(F.col("n") > CHUNK).collect()}  # only the large groups


def _members(classes: DataFrame, shared, large: dict[int, int]) -> DataFrame:
    """A row for each group (and pair of chunks of it) that a class visits, with the cells that it visits, its own first."""
    names = ["grp", "ca", "cb", "chunk", "cid", "m", "size", "cells", "embedding"]
    chunks = {g: -(-n // CHUNK) for g, n in large.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        k2, most = len(index.block), index.radius**2
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                (n1, n2), (l1, l2) = index.bounds(unit(b.column(3), index.dim))
                reach = ((l1 <= most).sum(axis=1) > 1) | ((l2 <= most).sum(axis=1) > 1)
                own, cids = (n1 * k2 + n2).tolist(), b.column(0).to_pylist()
                cells, ends, rows, grp, ca, cb, chunk = [], [0], [], [], [], [], []
                for i in range(b.num_rows):
                    mine = [own[i]]
                    if reach[i]:
                        mine += [c for p, q in visited(l1[i], l2[i], most) if (c := p * k2 + q) != own[i]]
                    cells += mine
                    ends.append(len(cells))
                    for g in set(index.groups(np.array(mine)).tolist()):
                        k = chunks.get(g, 1)
                        c = (cids[i] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20
                        c %= k
                        for o in range(k):
                            rows.append(i)
                            grp.append(g)
                            ca.append(min(c, o))
                            cb.append(max(c, o))
                            chunk.append(c)
                take = pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp, pa.int64()), *[pa.array(x, pa.int32()) for x in (ca, cb, chunk)], *[b.column(j).take(take) for j in range(3)],
                     lists.take(take), b.column(3).take(take)], names,
                )

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("cid", "m", F.size("embedding").alias("size"), "embedding").mapInArrow(
        run, f"grp long, ca int, cb int, chunk int, cid long, m long, size int, cells array<int>, embedding {kind}"
    )


def _compare(shared, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        index: MultiIndex = shared.value
        grp, ca, cb = (t.column(n)[0].as_py() for n in ("grp", "ca", "cb"))
        t = t.sort_by("cid")
        cid, m, size, chunk = (t.column(n).to_numpy() for n in ("cid", "m", "size", "chunk"))
        x = unit(t.column("embedding").combine_chunks(), index.dim)
        lists = t.column("cells").combine_chunks()
        cells, n_cells = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(x)), n_cells)
        own = cells[np.cumsum(n_cells) - n_cells]
        n_grid = len(index.halves[0]) * len(index.block)
        visits = np.sort(row * n_grid + cells)  # (row, cell) as one number

        def comes(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            """Whether a row visits a cell."""
            code = rows * n_grid + to
            return visits[np.minimum(np.searchsorted(visits, code), len(visits) - 1)] == code

        here = index.groups(cells) == grp
        cell, member = cells[here], row[here]
        order = np.lexsort([member, cell])
        cell, member = cell[order], member[order]
        counts, ea, eb = np.zeros(len(x), np.int64), [], []

        def meet(a: np.ndarray, b: np.ndarray, c: int, same: bool, guests: bool) -> None:
            """Compare rows a, which live in cell c, with rows b: residents (the same ones, or others) or guests."""
            for i in range(0, len(a), BLOCK):
                for j in range(i if same else 0, len(b), BLOCK):
                    u, v = a[i : i + BLOCK], b[j : j + BLOCK]
                    near = (x[u] @ x[v].T >= threshold) & (size[u][:, None] == size[v][None, :])
                    if same and i == j:
                        near = np.triu(near, 1)
                    if not near.any():
                        continue
                    if guests:
                        # If each visits the other's cell, the pair counts in the cell of larger number.
                        p, q = np.nonzero(near & (own[v] > c)[None, :])
                        twice = comes(u[p], own[v[q]])
                        near[p[twice], q[twice]] = False
                    counts[u] += near.astype(np.int64) @ m[v]
                    counts[v] += near.T.astype(np.int64) @ m[u]
                    p, q = spanning(cid[u], cid[v], near)
                    ea.append(p)
                    eb.append(q)

        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            c, rows = int(cell[s]), member[s:e]
            home = own[rows] == c
            live, come = rows[home], rows[~home]
            if ca == cb:
                meet(live, live, c, True, False)
                meet(live, come, c, False, True)
            else:
                left, right, first, second = live[chunk[live] == ca], live[chunk[live] == cb], come[chunk[come] == ca], come[chunk[come] == cb]
                meet(left, right, c, False, False)
                meet(left, second, c, False, True)
                meet(right, first, c, False, True)
        some = counts > 0
        a = np.concatenate([cid[some], *ea])
        b = np.concatenate([cid[some], *eb])
        n = np.concatenate([counts[some], np.zeros(sum(map(len, ea)), np.int64)])
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n})

    return run


def _classes(keyed: DataFrame) -> DataFrame:
    """(cid, k1, k2, m, least, embedding) of each different vector of keyed(vec_id, k1, k2, embedding).

    Only digests are shuffled to find the vectors that repeat, and only those are grouped, unless there are too
    many to broadcast.
    """
    one = [F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least")]
    repeats = keyed.groupBy("k1", "k2").agg(*one).where("m > 1")
    repeats = stage(repeats, "repeats")
    if repeats.count() > BROADCAST_REPEATS:
        rows = keyed.groupBy("k1", "k2", "embedding").agg(*one)
    else:
        marked = keyed.join(F.broadcast(repeats), ["k1", "k2"], "left")
        single = marked.where("m is null").select("k1", "k2", "embedding", F.lit(1).cast("long").alias("m"), F.col("vec_id").alias("least"))
        several = marked.where("m is not null").groupBy("k1", "k2", "embedding", "m", "least").agg(F.lit(1).alias("_")).drop("_")
        rows = single.unionByName(several)
    out = stage(rows.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    drop_staged(repeats)
    return out


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = need(vectors, "vec_id", "embedding")
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    # The digests of an unsound vector are null.
    rows = rows.withColumns({"k1": F.when(sound, F.xxhash64("embedding")), "k2": F.when(sound, F.xxhash64(F.lit(1), "embedding"))})
    classes = _classes(rows.where("k1 is not null"))
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone
    most = max(SAMPLE, PER_CENTROID * centroids(n))
    wanted = min(1.0, most / n)
    picked = classes.where(F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(1_000_000)) < F.lit(wanted * 1_000_000)).select("embedding")
    listed = picked.limit(2 * most).toArrow() if wanted < 1 else classes.select("embedding").limit(most).toArrow()
    if not listed.num_rows:
        listed = classes.select("embedding").limit(100).toArrow()
    sample = unit(listed.column(0).combine_chunks(), dim)
    index = fit(sample, n, threshold, target_recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of at most MOST_CENTROIDS rows
    members = _members(classes, shared, _sizes(classes, shared))
    found = stage(members.groupBy("grp", "ca", "cb").applyInArrow(_compare(shared, threshold), "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    # Only vectors that link or repeat take part from here on; all others stand alone.
    of = classes.select("cid", "k1", "k2", "m", "least").join(counts, "cid", "left").where("n is not null or m > 1").join(joined, "cid", "left")
    of = stage(of.select("k1", "k2", "m", "least", F.coalesce("component", "cid").alias("component"), F.coalesce("n", F.lit(0)).alias("n")), "linked")
    for t in (found, classes):
        drop_staged(t)
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("k1", "k2", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id", F.lit(True).alias("links"))
    out = rows.select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Brute force over all pairs, and the reachable minimum by a recursive query.
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, p.y FROM r JOIN p ON r.t = p.x),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY x) l USING (vec_id)
"""
