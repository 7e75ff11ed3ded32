"""First-fit-decreasing packing with a tournament tree, in randomised groups.

Documents are tokenised and cut: whole sequences first, then one remainder.
Whole sequences fill a bin each and are named where they lie, without a
shuffle. Remainders are dealt at random (by a hash of their place in the staged
files, so rows that repeat are dealt like any others) to groups of about
`group_pieces`; each group is packed alone, largest remainder first, into the
first bin with room, which a tournament tree over the bins' free room finds in
logarithmic time. Groups are tasks of bounded size, so no step sees all lengths.

Defined cases: a null or empty text is the single id that ends a document; an
empty table gives an empty table; repeated rows are packed as they come (each
id of each row lies in one piece); a null doc_id is packed and stays null; a
text of any length is tokenised whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, stage

VOCABULARY, END_ID, LENGTH, GROUP_PIECES = "word_bpe_49k.json", 2, 4096, 8192
#: Sequences that a group fills at least (there is one group if there are fewer).
GROUP_SEQUENCES = 64
#: Bytes that a worker may spend on remembered words and their ids (besides those of the text in hand).
REMEMBERED = 384 << 20
#: What a remembered word costs besides its characters and ids.
_EACH = 200
#: str.split cuts at these, the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_MARK = "|"
#: Words of Latin letters with ASCII punctuation after them: their case folds letter by letter and they are in
#: normal form already, so the letters can go to the merges directly.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")
#: Printable stand-ins of the 256 bytes, by the usual rule of byte-level vocabularies.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_STAND_IN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, from remembered ids of words.

    The vocabulary's rules never look across white space, so the ids of a text
    are those of its words in order. New words of a batch are tokenised in one
    call, with a mark between them.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known when `known` last grew full
        self.held = 0  # bytes of what was learned since then
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        mark = self.direct(_MARK)
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 else None

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, core: str) -> bytes:
        """Ids of a run of lower-case Latin letters."""
        shown = core if core.isascii() else "".join(map(_STAND_IN.__getitem__, core.encode()))
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)])
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def learn(self, words: list[str]) -> None:
        self.held += 3 * _EACH * len(words) + 4 * sum(map(len, words))
        rest = []
        for w in words:
            if (ids := self.before.get(w)) is not None:
                self.known[w] = ids
                continue
            m = _PLAIN.fullmatch(w)
            if m is None:
                rest.append(w)
                continue
            core, tail = m[1].lower(), m[2]
            if (ids := self.cores.get(core)) is None:
                ids = self.cores[core] = self.letters(core)
            if tail:
                if (end := self.tails.get(tail)) is None:
                    end = self.tails[tail] = self.direct(tail)
                ids += end
            self.known[w] = ids
        marked = [w for w in rest if _MARK in w or self.mark is None]
        self.known.update((w, self.direct(w)) for w in marked)
        plain = [w for w in rest if _MARK not in w and self.mark is not None]
        for k in range(0, len(plain), 5000):
            some = plain[k : k + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:  # a word that the rules join to the mark
                self.known.update((w, self.direct(w)) for w in some)
                continue
            ends = [*(cuts * 4).tolist(), len(ids) * 4]
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends):
                self.known[w] = raw[start:end]
                start = end + 4

    def forget(self) -> None:
        """Keep half of what may be remembered: what was learned last."""
        if self.held > REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0
            self.cores.clear()
            self.tails.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text."""
        out = []
        for t in texts:
            self.forget()
            known, get = self.known, self.known.__getitem__
            if _ODD.search(t):
                out.append(self.direct(t))
                continue
            words = t.split()
            new = set(words).difference(known)
            if new:
                self.learn(list(new))
            out.append(b"".join(map(get, words)))
        return out


_tokenizers: dict[str | None, WordTokenizer] = {}


def _pieces(docs: DataFrame, tokenizer_path: str | None, length: int, end_id: int, with_ids: bool) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        t = _tokenizers[tokenizer_path]
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                doc, start, size, crc, total, ids = [], [], [], [], [], []
                for d, raw in zip(part.column(0).to_pylist(), t.ids(texts)):
                    raw += end
                    for at in range(0, len(raw), 4 * length):
                        piece = raw[at : at + 4 * length]
                        doc.append(d)
                        start.append(at // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(raw) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return need(docs, "doc_id", "text").mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its offset there; items come in any order, equal sizes keep theirs.

    The tree's leaves are the bins' free room, each inner node the larger of its
    two children: from the root the leftmost leaf with enough room is reached.
    """
    n, leaves = len(sizes), 1
    while leaves < max(n, 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            most = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(
    docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None,
    group_pieces: int = GROUP_PIECES, with_ids: bool = False, seed: int = 1,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    sequence_id holds the group in its upper and the bin in its lower half; those of whole sequences have
    bit 62 and hold the piece's file and row.
    """
    pieces = stage(_pieces(docs, tokenizer_path, length, end_id, with_ids), "pieces")
    # A piece is named by its place: the number of its file (of the task that wrote it) and its row there.
    file = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long")
    placed = pieces.select(*pieces.columns, file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = placed.where(F.col("length") < length)
    n, tokens = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # Each group may leave one sequence unfilled, so a group has that many sequences at least.
    groups = max(1, min(-(-n // group_pieces), tokens // (GROUP_SEQUENCES * length)))
    part = part.withColumn("grp", F.pmod(F.xxhash64("_file", "_row", F.lit(seed)), F.lit(groups))).drop("_file", "_row")

    def deal(it: Iterator[pa.Table]) -> pa.Table:
        t = it
        order = np.lexsort([t.column(n).to_numpy(zero_copy_only=False) for n in ("ids_crc32", "start", "doc_id")])
        t = t.take(pa.array(order))
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
        grp = t.column("grp").to_numpy()
        t = t.drop_columns(["grp"])
        return t.append_column("sequence_id", pa.array((grp << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = part.groupBy("grp").applyInArrow(deal, schema)
    whole = placed.where(F.col("length") == length)
    named = F.lit(1 << 62) + F.shiftleft("_file", 36) + F.col("_row")
    return packed.unionByName(whole.withColumns({"sequence_id": named, "offset": F.lit(0).cast("long")}).drop("_file", "_row"))
