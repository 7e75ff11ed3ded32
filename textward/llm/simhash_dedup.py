"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits, each the majority of the XXH64 bits of its
4-word shingles. Bits that go together, measured over all fingerprints, share
one of m partitions. If the thresholds t_i of the partitions satisfy
sum(t_i + 1) = max_bits + 1, two fingerprints within max_bits bits are within
t_i bits in at least one partition; a dynamic programme picks m and unequal
thresholds for the least estimated probes and candidates, the latter counted
among sampled fingerprints, so that what the bits of a partition have in common
counts too. Within t_i bits in t_i + 1 pieces of a partition means equal in one
piece, so a fingerprint is sent to its region of each piece, max_bits + 1 rows
whatever the plan; the signatures of the partition that are within t_i bits are
looked up in the region's task, each by the first piece that is equal. What
meets is verified by the whole Hamming distance, and a task hands on a spanning
forest of the links, never their pairs. A region of very many fingerprints is
cut into chunks, and every pair of chunks is a task of its own.

Edited copies often lie further apart than max_bits of 64 bits, and a larger
max_bits alone would link strangers in a large corpus. one_of_each therefore
probes to NEAR_BITS bits and verifies candidates by 128 further bits, set in
the same way from another hash: of the 192 bits, at most NEAR_TOTAL may differ.

Defined cases: a text without words, or null, has fingerprint zero and links
like any other; equal texts share a fingerprint, hence a component; a null
doc_id gets its fingerprint and the smallest id of its component (null if that
has none), and stays as that component's one row only if it has no row with an
id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, drop_staged, need, stage
from .components import components
from .linking import forest, spanning

SEED, SHINGLE, BITS, MAX_BITS = 42, 4, 64, 4
#: one_of_each: bits of 64 that candidates may differ in, and bits of 192 that near-duplicates may.
NEAR_BITS, NEAR_TOTAL = 8, 32
#: Fingerprints that candidates are counted among, for the plan.
SAMPLE = 2048
#: Costs of one row through a shuffle, of one signature looked up and of one verified candidate, in microseconds.
ROW_COST, LOOKUP_COST, CANDIDATE_COST = 1.5, 0.04, 0.01
#: Rows of one region that a task holds at once; more are cut into chunks.
CHUNK = 1 << 16
#: Rows that a task gathers before it looks signatures up, candidates that it verifies at once, candidates of two
#: groups of equal signatures from which on they are compared as a matrix, and the longest side of one.
GATHERED, SLAB, DENSE, BLOCK = 1 << 16, 1 << 19, 1 << 14, 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 16


def _majority(digests: np.ndarray, counts: np.ndarray) -> None:
    counts += np.unpackbits(digests.view(np.uint8).reshape(-1, len(counts) // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _packed(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def wide_fingerprint(text: bytes | None, wide: bool = True) -> np.ndarray:
    """Fingerprint of a text in UTF-8 and, if wide, two further words from XXH3."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(3 if wide else 1, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    first, more = np.zeros(BITS, np.int64), np.zeros(2 * BITS, np.int64)
    digest, further = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
    for k in range(0, n, _SLICE):
        shingles = [joined[s : e - 1] for s, e in zip(starts[k : min(n, k + _SLICE)], last[k : k + _SLICE])]
        _majority(np.array([digest(x, SEED) for x in shingles], "<u8"), first)
        if wide:
            _majority(np.frombuffer(b"".join([further(x, SEED) for x in shingles]), np.uint8), more)
    return np.concatenate([_packed(first, n), _packed(more, n)]) if wide else _packed(first, n)


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of a text in UTF-8, as an unsigned integer."""
    return int(wide_fingerprint(text, False)[0])


def fingerprints(docs: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, more1, more2): the fingerprint of each row of docs as a signed long, and its further
    words (zero unless wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, 3), np.uint64)
            for i, x in enumerate(b.column(2)):
                own = wide_fingerprint(x.as_py(), wide)
                out[i, : len(own)] = own
            columns = [pa.array(np.ascontiguousarray(out[:, j]).view(np.int64)) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_hash", "fp", "more1", "more2"])

    rows = need(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, more1 long, more2 long")


def _bit_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS), np.int64), 0
    for b in batches:
        x = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        for k in range(0, len(x), _SLICE):
            bits = np.unpackbits(x[k : k + _SLICE], axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([n])], ["products", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count of all fingerprints, and how often each pair of bits is set together."""
    sums = fps.select("fp").mapInArrow(_bit_products, "products array<long>, n long")
    cells = sums.select("n", F.posexplode("products")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    rows = cells.collect()  # 4096 cells whatever the input
    products = np.zeros(BITS * BITS)
    for r in rows:
        products[r["pos"]] = r["s"]
    return (rows[0]["n"] if rows else 0), products.reshape(BITS, BITS)


def partition_bits(n: int, products: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near equal size; correlated bits go to the same group."""
    p = np.diag(products) / max(n, 1)
    cov = products / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def _near(p: np.ndarray, group: list[int], most: int, sample: np.ndarray) -> list[float]:
    """For t = 0..most: the estimated chance that two fingerprints differ in at most t bits of the group.

    Counted among pairs of the sample; where those are too few to tell, at least what independent bits would give.
    """
    dist = np.zeros(most + 1)
    dist[0] = 1
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - differ) + np.concatenate([[0], dist[:-1]]) * differ
    alone = np.cumsum(dist)
    if len(sample) < 2:
        return list(alone)
    own = sample & np.uint64(_mask(group))
    found = np.zeros(BITS + 1, np.int64)
    for k in range(0, len(own), 256):
        found += np.bincount(np.bitwise_count(own[k : k + 256, None] ^ own[None, :]).ravel(), minlength=BITS + 1)
    found[0] -= len(own)  # each with itself
    return list(np.maximum(alone, np.cumsum(found[: most + 1]) / (len(own) * (len(own) - 1))))


def _meet(p: np.ndarray, bits: list[int], sample: np.ndarray) -> float:
    """The estimated chance that two fingerprints are equal in these bits."""
    alone = float(np.prod([1 - 2 * p[b] * (1 - p[b]) for b in bits]))
    if len(sample) < 2:
        return alone
    counts = np.unique(sample & np.uint64(_mask(bits)), return_counts=True)[1]
    return max(alone, float((counts * (counts - 1)).sum()) / (len(sample) * (len(sample) - 1)))


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _split(bits: list[int], t: int) -> list[list[int]]:
    """The t + 1 pieces of a partition with threshold t."""
    return [bits[j :: t + 1] for j in range(t + 1)]


def plan(n: int, products: np.ndarray, max_bits: int = MAX_BITS, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, by dynamic programming; sample holds fingerprints."""
    p = np.diag(products) / max(n, 1)
    sample = np.zeros(0, np.uint64) if sample is None else sample
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, max_bits + 2):
        groups = partition_bits(n, products, m)
        # state: how much of max_bits + 1 is allotted -> (cost, thresholds)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            most = min(3, max_bits)
            near, costs, after = _near(p, g, most, sample), {-1: 0.0}, {}
            for t in range(most + 1):
                lookups = sum(comb(len(g), j) for j in range(t + 1))
                rows = sum(1 + n * _meet(p, piece, sample) / CHUNK for piece in _split(g, t))
                costs[t] = n * rows * ROW_COST + n * lookups / 2 * LOOKUP_COST + n * n / 2 * near[t] * CANDIDATE_COST
            for used, (cost, chosen) in state.items():
                for t in range(-1, min(3, max_bits - used) + 1):
                    c = cost + costs[t]
                    if used + t + 1 not in after or c < after[used + t + 1][0]:
                        after[used + t + 1] = (c, [*chosen, t])
            state = after
        if max_bits + 1 in state and state[max_bits + 1][0] < best[0]:
            best = (state[max_bits + 1][0], [(g, t) for g, t in zip(groups, state[max_bits + 1][1]) if t >= 0])
    return best[1]


class Piece(NamedTuple):
    """Fingerprints that are equal in `mask` meet; those whose signatures in `whole` differ by one of `flips` are candidates."""

    mask: int
    whole: int
    flips: np.ndarray


def pieces(parts: list[tuple[list[int], int]]) -> list[Piece]:
    """The pieces of all partitions. Each flip of a partition belongs to the first piece that it leaves equal."""
    out = []
    for bits, t in parts:
        flips = [_mask(s) for j in range(t + 1) for s in combinations(bits, j)]
        for own in map(_mask, _split(bits, t)):
            out.append(Piece(own, _mask(bits), np.array([f for f in flips if not f & own], np.uint64)))
            flips = [f for f in flips if f & own]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _regions(fps: DataFrame, at: list[Piece]) -> DataFrame:
    """(part, sig, fp, more1, more2): the region of each fingerprint in each piece."""
    each = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(x.mask))).alias("sig")) for i, x in enumerate(at)]
    return fps.select("fp", "more1", "more2", F.explode(F.array(*each)).alias("k")).select("k.*", "fp", "more1", "more2")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def _linked(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], max_bits: int, most: int | None) -> np.ndarray:
    """Whether fingerprints (fp, more1, more2) link: by the first word, and by all three if `most` is given."""
    first = _differing(x[0], y[0])
    near = first <= max_bits
    if most is not None and near.any():
        near &= first.astype(np.int16) + _differing(x[1], y[1]) + _differing(x[2], y[2]) <= most
    return near


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, size numbers long, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class _Groups:
    """Rows sorted by their signature, and where the groups of equal ones begin."""

    def __init__(self, words: list[np.ndarray], whole: int):
        sig = words[0].view(np.uint64) & np.uint64(whole)
        order = np.argsort(sig)
        sig, self.words = sig[order], [w[order] for w in words]
        self.start = np.flatnonzero(np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]]))
        self.size = np.diff(np.append(self.start, len(sig)))
        self.sig = sig[self.start]

    def meet(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given signatures are here, and the numbers of their groups."""
        at = np.minimum(np.searchsorted(self.sig, sig), len(self.sig) - 1)
        found = np.flatnonzero(self.sig[at] == sig)
        return found, at[found]


def _compared(x: _Groups, y: _Groups, flips: np.ndarray, max_bits: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of x and y whose signatures differ by a flip; y may be x, then each pair is met once."""
    left, right, rows = [], [], 0
    for k, f in enumerate(flips):
        flipped = x.sig ^ f
        use = np.flatnonzero(flipped < x.sig) if x is y and f else np.arange(len(x.sig))
        found, at = y.meet(flipped[use])
        left.append(use[found])
        right.append(at)
        rows += x.size[left[-1]].sum()
        if rows > SLAB or k == len(flips) - 1:
            yield from _groups_compared(x, y, np.concatenate(left), np.concatenate(right), max_bits, most)
            left, right, rows = [], [], 0


def _groups_compared(x: _Groups, y: _Groups, g: np.ndarray, h: np.ndarray, max_bits: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the rows of groups g of x and of groups h of y."""
    same = x is y
    dense = x.size[g] * y.size[h] >= DENSE
    for u, v in zip(g[dense], h[dense]):
        for i in range(x.start[u], x.start[u] + x.size[u], BLOCK):
            for j in range(i if same and u == v else y.start[v], y.start[v] + y.size[v], BLOCK):
                a = [w[i : min(i + BLOCK, x.start[u] + x.size[u])] for w in x.words]
                b = [w[j : min(j + BLOCK, y.start[v] + y.size[v])] for w in y.words]
                yield spanning(a[0], b[0], _linked([w[:, None] for w in a], [w[None, :] for w in b], max_bits, most))
    g, h = g[~dense], h[~dense]
    # Each row i is held against `count` rows from `first` on.
    i, count, first = _ranges(x.start[g], x.size[g]), np.repeat(y.size[h], x.size[g]), np.repeat(y.start[h], x.size[g])
    if same:
        own = np.repeat(g == h, x.size[g])
        count, first = np.where(own, first + count - i - 1, count), np.where(own, i + 1, first)
    ends = np.cumsum(count)
    k = 0
    while k < len(i):
        before = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, before + SLAB, "right")))
        j = _ranges(first[k:stop], count[k:stop])
        near = np.flatnonzero(_differing(np.repeat(x.words[0][i[k:stop]], count[k:stop]), y.words[0][j]) <= max_bits)
        if len(near):
            u, v = i[k + np.searchsorted(ends[k:stop] - before, near, "right")], j[near]
            ok = _linked([w[u] for w in x.words], [w[v] for w in y.words], max_bits, most)
            yield x.words[0][u[ok]], y.words[0][v[ok]]
        k = stop


def _links_of(rows: list[np.ndarray], at: list[Piece], max_bits: int, most: int | None) -> pa.RecordBatch:
    """Spanning links of whole runs of equal (part, sig, ca, cb)."""
    part, sig, ca, cb, chunk, *words = rows
    a, b, held = [], [], 0

    def add(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal a, b, held
        for x, y in found:
            a, b, held = [*a, x], [*b, y], held + len(x)
            if held > SLAB:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0

    first = (ca == 0) & (cb == 0)  # one run of a region at most, so that signatures tell the regions apart
    for i in np.unique(part[first]):
        use = first & (part == i)
        own = _Groups([w[use] for w in words], at[i].whole)
        add(_compared(own, own, at[i].flips, max_bits, most))
    more = np.flatnonzero(~first)
    new = np.zeros(len(more), bool)
    for x in (part, sig, ca, cb):
        new[1:] |= x[more[1:]] != x[more[:-1]]
    for run in np.split(more, np.flatnonzero(new)) if len(more) else []:
        p, u, v = at[part[run[0]]], ca[run[0]], cb[run[0]]
        sides = [_Groups([w[run[chunk[run] == c]] for w in words], p.whole) for c in sorted({u, v})]
        if all(len(s.sig) for s in sides):
            add(_compared(sides[0], sides[-1], p.flips, max_bits, most))
    a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (words[0][:0], words[0][:0])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], at: list[Piece], max_bits: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, sig, ca, cb); a run of equal keys is compared within itself."""
    kept: list[list[np.ndarray]] = []
    held, enough = 0, GATHERED
    for b in batches:
        if not b.num_rows:
            continue
        kept.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(8)])
        held += b.num_rows
        if held < enough:
            continue
        now = [np.concatenate(x) for x in zip(*kept)]
        same = np.ones(held, bool)
        for x in now[:4]:
            same &= x == x[-1]
        cut = held - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield _links_of([x[:cut] for x in now], at, max_bits, most)
        kept, held = [[x[cut:] for x in now]], held - cut
        enough = max(GATHERED, 2 * held)
    if held:
        yield _links_of([np.concatenate(x) for x in zip(*kept)], at, max_bits, most)


def links(fps: DataFrame, max_bits: int = MAX_BITS, most: int | None = None) -> DataFrame:
    """fps(fp, more1, more2): distinct fingerprints. Returns links (a, b) that span the near pairs' components. Near
    is within max_bits bits of fp and, if `most` is given, within so many bits of all three words."""
    n, products = bit_statistics(fps)
    share = F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40)))
    some = fps.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 40)) <= share).select("fp").limit(2 * SAMPLE).toArrow()
    sample = some.column(0).to_numpy().view(np.uint64)
    at = pieces(plan(n, products, max_bits, sample))
    rows = _regions(fps, at)
    # At most (max_bits + 1) * n / CHUNK regions are hot.
    hot = rows.groupBy("part", "sig").count().where(F.col("count") > CHUNK)
    rows = rows.join(F.broadcast(hot), ["part", "sig"], "left")
    n_chunks = F.coalesce(F.ceil(F.col("count") / CHUNK), F.lit(1)).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), n_chunks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda o: F.struct(F.least("chunk", o).alias("ca"), F.greatest("chunk", o).alias("cb")))
    names = ["chunk", "fp", "more1", "more2"]
    rows = rows.select("part", "sig", F.explode(others).alias("c"), *names).select("part", "sig", "c.ca", "c.cb", *names)
    return (
        rows.repartition("part", "sig", "ca", "cb")
        .sortWithinPartitions("part", "sig", "ca", "cb")
        .mapInArrow(lambda it: _verify(it, at, max_bits, most), "a long, b long")
    )


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, most: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of each row of docs; component names the group, also one
    without an id."""
    prints = stage(fingerprints(docs, most is not None), "fingerprints")
    words = F.min(F.struct("more1", "more2")).alias("more")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), words).select("fp", "least", "more.more1", "more.more2")
    fps = stage(fps, "distinct-fingerprints")
    joined = components(links(fps.select("fp", "more1", "more2"), max_bits, most))
    of = fps.select("fp", "least").join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of = stage(of, "fingerprint-components")
    drop_staged(fps)
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def simhash_report(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return simhash_components(docs, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, max_bits: int = NEAR_BITS, most: int | None = NEAR_TOTAL) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, or any one if none of
    its rows has an id.

    Rows that repeat that doc_id and text are one; rows of other components do not suffer from an id of their own
    that is the same.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))).alias("first")
    stay = simhash_components(docs, max_bits, most).groupBy("component").agg(first)
    stay = stay.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")).distinct()
    safe, names = carried(docs, "doc_id", "text")
    # One partitioning, by id and digest of the text, serves the join and the removal of repeats.
    safe = safe.withColumns({"__own": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__digest": F.xxhash64("text")})
    stay = stay.select(F.coalesce("__id", F.lit(0)).alias("__own"), F.col("__id").isNull().alias("__none"), F.col("__hash").alias("__digest"))
    kept = safe.join(stay, ["__own", "__none", "__digest"]).dropDuplicates(["__own", "__none", "__digest"])
    return kept.select(*names).toDF(*docs.columns)
