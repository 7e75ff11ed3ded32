"""Language ID by prediction by partial matching.

For each language a context tree of bytes, of variable order up to 3, holds what
followed each context in its training sample. A byte's code length follows
escape method C with exclusion: in the longest context that the language knows,
a byte seen there costs its share, any other an escape to the next shorter
context, where what the longer one offered is left out; a byte that the
language never saw is one of the remaining bytes, all alike. No context and no
byte is left out or merged, and the statistics are frozen after training, so
every code length is exact. The language with the shortest code for a whole
text wins; the score is its share of 2^-length over all languages.

Training reads only text and non-null lang of documents whose crc32(doc_id as
text) mod 5 is not 0, and of those a bounded sample: about `train_bytes` bytes
for each language, at most TOTAL_BYTES for all together, from documents that a
hash of the row chooses. A document gives one window of WINDOW characters at a
place that the hash chooses, so long texts train like others; the document with
the smallest hash of each language is always among them. At most MOST_LANGUAGES
languages are learned, those with most text.

keep_known also rejects a text that even its best language explains badly: more
bits a byte than that language's own held-out texts need (half of the sample
against trees of the other half), with a margin.

Defined cases: a null text, or one without a letter, is `und` with score 0; so
is every text if nothing could be learned; equal code lengths go to the first
language in order of name; a null doc_id counts as held out; repeated rows are
scored one by one and train once; an empty table gives an empty table; extra
columns of any name and type are ignored, or carried by keep_known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import literal
from .common import carried, need

FOLDS, ORDER = 5, 3
#: Bounds of the training sample: bytes a language and in all, characters of a document, languages.
TRAIN_BYTES, TOTAL_BYTES, WINDOW, MOST_LANGUAGES = 400_000, 8_000_000, 10_000, 256
#: Bytes of text scored at once, and of the table of code lengths that are worked out beforehand.
SLICE, TABLE_BYTES = 1 << 18, 64 << 20
#: keep_known: times the held-out bits a byte, plus bits for any text, that a known language may need.
MARGIN, SPARE_BITS = 1.2, 300.0
_HASHES = 1 << 40


class Tree:
    """Contexts of one language: what followed them, and the costs of escaping from them."""

    def __init__(self, stream: np.ndarray, a: int):
        self.a = a
        self.keys, self.counts, self.nodes, own, kinds = [], [], [], [], []
        for q in range(ORDER + 1):
            key = np.zeros(max(0, len(stream) - ORDER), np.int64)
            for j in range(q + 1):
                key = key * a + stream[ORDER - q + j : len(stream) - q + j]
            keys, counts = np.unique(key[key % a != 0], return_counts=True)  # the mark before a text is never predicted
            nodes, first = np.unique(keys // a, return_index=True)
            self.keys.append(keys)
            self.counts.append(counts.astype(np.float64))
            self.nodes.append(nodes)
            kinds.append(np.diff(np.append(first, len(keys))).astype(np.float64))
            own.append(np.add.reduceat(self.counts[q], first) if len(first) else np.zeros(0))
        self.left = max(1, 256 - (int(kinds[0][0]) if len(kinds[0]) else 0))
        #: Entered first, and entered from a node one order longer: bits of the whole, and of an escape.
        self.whole, self.escape, self.rest, self.further = [], [], [None], [None]
        for q in range(ORDER + 1):
            self.whole.append(np.log2(own[q] + kinds[q]))
            self.escape.append(self.whole[q] - np.log2(np.maximum(kinds[q], 1)))
            if q:
                # What a node offers was counted by its suffix too; there it is left out.
                there = self.counts[q - 1][np.searchsorted(self.keys[q - 1], self.keys[q] % a**q)]
                first = np.searchsorted(self.keys[q], self.nodes[q] * a)
                shown = np.add.reduceat(there, first) if len(first) else np.zeros(0)
                up = np.searchsorted(self.nodes[q - 1], self.nodes[q] % a ** (q - 1))
                total, new = own[q - 1][up] - shown, kinds[q - 1][up] - kinds[q]
                self.rest.append(np.log2(np.maximum(total + new, 1)))
                self.further.append(np.where(new > 0, self.rest[q] - np.log2(np.maximum(new, 1)), 0.0))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last of each four symbols after the other three."""
        history, x = grams // self.a, grams % self.a
        out, at = np.zeros(len(grams)), np.full(len(grams), -1)  # at: the node that was escaped from
        left = np.arange(len(grams))
        for q in range(ORDER, -1, -1):
            context = history[left] % self.a**q
            node = np.minimum(np.searchsorted(self.nodes[q], context), len(self.nodes[q]) - 1)
            known = self.nodes[q][node] == context
            some, n = left[known], node[known]
            key = context[known] * self.a + x[some]
            i = np.minimum(np.searchsorted(self.keys[q], key), len(self.keys[q]) - 1)
            hit = self.keys[q][i] == key
            come = at[some]
            if q < ORDER:
                whole = np.where(come >= 0, self.rest[q + 1][come], self.whole[q][n])
                escape = np.where(come >= 0, self.further[q + 1][come], self.escape[q][n])
            else:
                whole, escape = self.whole[q][n], self.escape[q][n]
            out[some] += np.where(hit, whole - np.log2(self.counts[q][i]), escape)
            at[some] = n
            done = np.zeros(len(grams), bool)
            done[some[hit]] = True
            left = left[~done[left]]
        out[left] += np.log2(self.left)
        return out


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each byte: 0 stands before a text, 1 for a byte that no sample holds
    n_symbols: int
    trees: list[Tree]
    known: np.ndarray  # four symbols each, sorted
    cost: np.ndarray  # their bits for each language
    most_bits: np.ndarray  # a byte, that keep_known lets a text of each language need


def _stream(texts: list[bytes], symbol: np.ndarray) -> np.ndarray:
    pad = np.zeros(ORDER, np.int64)
    parts = [pad]
    for text in texts:
        if text:
            parts += [pad, symbol[np.frombuffer(text, np.uint8)].astype(np.int64)]
    return np.concatenate(parts)


def train(samples: dict[str, list[bytes]]) -> Model:
    """Context trees from texts of each language."""
    languages = sorted(k for k, v in samples.items() if any(v))
    seen = np.zeros(256, bool)
    for k in languages:
        for text in samples[k]:
            seen[np.frombuffer(text, np.uint8)] = True
    symbol = np.ones(256, np.uint16)
    symbol[seen] = np.arange(int(seen.sum())) + 2
    a = int(seen.sum()) + 2
    trees = [Tree(_stream(samples[k], symbol), a) for k in languages]
    most = []
    for k in languages:
        texts = [t for t in samples[k] if t]
        rates = [0.0]
        for mine, other in ((texts[::2], texts[1::2]), (texts[1::2], texts[::2])):
            if mine and other:
                half = Tree(_stream(mine, symbol), a)
                one = Model([k], symbol, a, [half], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros(1))
                rates += [max(0.0, b - SPARE_BITS) / len(t) for b, t in zip(code_lengths(one, other)[:, 0], other)]
        most.append(MARGIN * max(rates) if max(rates) > 0 else np.inf)
    # The code lengths of what the samples hold are worked out beforehand, the most frequent first if there are many.
    all_keys = np.concatenate([t.keys[ORDER] for t in trees])
    all_counts = np.concatenate([t.counts[ORDER] for t in trees])
    known, back = np.unique(all_keys, return_inverse=True)
    room = TABLE_BYTES // (8 + 4 * len(languages))
    if len(known) > room:
        often = np.argsort(-np.bincount(back, all_counts), kind="stable")[:room]
        known = np.sort(known[often])
    cost = np.empty((len(known), len(languages)), np.float32)
    for i, t in enumerate(trees):
        cost[:, i] = t.bits(known)
    return Model(languages, symbol, a, trees, known, cost, np.array(most))


def _costs(model: Model, stream: np.ndarray) -> np.ndarray:
    """Bits of each symbol of a stream after its first three, for each language."""
    s, a = stream.astype(np.int64), model.n_symbols
    gram = ((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:]
    if len(model.known):
        at = np.minimum(np.searchsorted(model.known, gram), len(model.known) - 1)
        out = model.cost.take(at, axis=0)
        new = np.flatnonzero((model.known[at] != gram) & (s[3:] != 0))
    else:
        out = np.zeros((len(gram), len(model.languages)), np.float32)
        new = np.flatnonzero(s[3:] != 0)
    if len(new):
        grams, back = np.unique(gram[new], return_inverse=True)
        for i, tree in enumerate(model.trees):
            out[new, i] = tree.bits(grams)[back]
    out[s[3:] == 0] = 0  # the marks before texts cost nothing
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text under each language."""
    out = np.zeros((len(texts), len(model.languages)))

    def score(stream: np.ndarray, first: list[int], rows: list[int]) -> None:
        np.add.at(out, rows, np.add.reduceat(_costs(model, stream), first, axis=0, dtype=np.float64))

    pad = np.zeros(ORDER, np.uint16)
    parts, first, rows, held = [pad], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        symbols = model.symbol[np.frombuffer(text, np.uint8)]
        for k in range(0, len(symbols), SLICE):
            piece = symbols[k : k + SLICE]
            if k:
                score(np.concatenate([symbols[k - ORDER : k], piece]), [0], [i])
                continue
            first.append(held)
            rows.append(i)
            parts += [piece, pad]
            held += len(piece) + ORDER
            if held >= SLICE:
                score(np.concatenate(parts), first, rows)
                parts, first, rows, held = [pad], [], [], 0
    if rows:
        score(np.concatenate(parts), first, rows)
    return out


def _sample(docs: DataFrame, train_bytes: int) -> dict[str, list[bytes]]:
    """A bounded sample of windows of text for each language."""
    n, size = F.length("text"), F.octet_length("text")
    rows = docs.where(
        F.col("lang").isNotNull() & (size > 0) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    ).withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(_HASHES)))
    sizes = rows.groupBy("lang").agg(F.sum(size * F.least(F.lit(1.0), F.lit(float(WINDOW)) / n)).alias("n"), F.min("h").alias("least"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return {}
    each = min(train_bytes, TOTAL_BYTES // len(sizes))
    below = [(r["lang"], max(int(min(1.0, each / r["n"]) * _HASHES), r["least"] + 1)) for r in sizes]
    chosen = rows.join(F.broadcast(literal(docs.sparkSession, ["lang", "below"], below)), "lang").where("h < below")
    window = F.substring(F.col("text"), (F.pmod(F.col("h"), F.greatest(n - WINDOW, F.lit(0)) + 1) + 1).cast("int"), F.lit(WINDOW))
    # Rows that repeat share a hash; of a group one trains.
    chosen = chosen.select("lang", "h", window.alias("w")).groupBy("lang", "h").agg(F.min("w").alias("w"))
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    held = dict.fromkeys(found, 0)
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"])):  # about `each` bytes a language
        if held[r["lang"]] < 2 * each:
            found[r["lang"]].append(r["w"].encode())
            held[r["lang"]] += len(found[r["lang"]][-1])
    return found


def predict(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of each row of docs."""
    docs = need(docs, "doc_id", "text", "lang")
    return _scored(docs, ["doc_id"], train_bytes).drop("explained")


def _scored(docs: DataFrame, keep: list[str], train_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    samples = _sample(docs.select("doc_id", "text", "lang"), train_bytes)
    model = train(samples) if any(any(v) for v in samples.values()) else None
    shared = spark.sparkContext.broadcast(model)  # bounded: contexts of the bounded sample
    kept = docs.select(*keep)
    out = [("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()), ("explained", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, kind) for name, kind in out]])
    n, names = len(keep), [*keep, *[name for name, _ in out]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text, lettered = b.column(n), b.column(n + 1).to_pylist()
            pred, score, rate, explained = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            known = [i for i, x in enumerate(lettered) if x] if m is not None else []
            if known:
                texts = [text[i].as_py() for i in known]
                bits = code_lengths(m, texts)
                least, best = bits.min(axis=1), bits.argmin(axis=1)
                share = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
                for i, j, s, t, x in zip(known, best, share, texts, least):
                    pred[i], score[i], rate[i] = m.languages[j], s, x / len(t)
                    explained[i] = x <= m.most_bits[j] * len(t) + SPARE_BITS
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(n)] + [b.column(n + 2), pa.array(pred), pa.array(score), pa.array(rate), pa.array(explained)],
                names,
            )

    rows = docs.select(
        *keep,
        F.col("text").cast("binary").alias("__t"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__l"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0).alias("__h"),
    )
    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, least_score: float = 0.5, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """docs, less the texts without a language: `und`, a best share under least_score, or one that no learned
    language explains."""
    safe, names = carried(docs, "doc_id", "text", "lang")
    scored = _scored(safe, names, train_bytes)
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score) & F.col("explained"))
    return kept.select(*names).toDF(*docs.columns)
