"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids are its tokens and one end id. It is cut into pieces of the capacity and a rest; a full piece fills a
sequence of its own, rests are packed with other rests. Groups are drawn by a hash of the document's id (and of how
often that id has been seen lately in the task, so that many rows of one id spread) and of the piece's place, hold at most
``GROUP_PIECES`` pieces on average, however long documents are, and are packed independently, so that no state is shared
between tasks. Inside a group the pieces go by falling
length to the first bin that has room; the tournament tree over the bins' free capacities finds it in log(bins).

Pieces carry start, length and checksum; ``with_ids`` gives the ids of each piece too, for writers.

Cases: null or empty text is the end id alone; repeated rows are packed each; a null id is kept; further columns, also of
clashing names, are ignored; empty table: no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 4096
CACHE_WORDS = 800_000
SEEN_IDS = 200_000
TOKENIZER = "word_bpe_49k.json"
SEED = 29

_BLANK = re.compile(r"[ \t\r\n]+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
_MARKS = ".,;:!?#$%&*|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts, word by word with a memory of words.

    It holds for tokenizers whose tokens never cross white space and which drop it, as this one. A word that is letters
    of Latin-1, then marks, is looked up as two parts, the letters in lower case, by the byte-pair model alone; all
    other words go through the whole tokenizer. Parts are words as well, so one memory holds both. It is emptied when it has
    grown to ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {ord(chr(b)): c for b, c in _byte_letters().items()}
        self.known: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _body(self, body: str) -> bytes:
        shown = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in words:
            body = w.rstrip(_MARKS)
            if body.isalpha() and (body.isascii() or max(body) <= "\xff"):
                low, tail = body.lower(), w[len(body) :]
                if low == w:
                    low = w  # one string for both
                if low not in known:
                    known[low] = self._body(low)
                if tail and tail not in known:
                    known[tail] = self._whole(tail)
                if w not in known:
                    known[w] = known[low] + known[tail] if tail else known[low]
            else:
                known[w] = self._whole(w)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # str.split() also splits at the separators 1C to 1F, which are no white space to the tokenizer
        split = [_BLANK.split(t) if _SEPARATOR.search(t) else t.split() for t in texts]
        words = set().union(*split)
        if new := words - self.known.keys():
            self._learn(new)
            if len(new) < len(words) and not words <= self.known.keys():  # the memory was emptied
                self._learn(words - self.known.keys())
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), dtype="<u4") for s in split]


_HELD: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its memory outlives a task."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]


class Tournament:
    """Leaves are bins' free capacities, inner nodes the larger of two; grows by doubling."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.bins = capacity, 1, 0
        self.tree = [0, 0]

    def _grow(self) -> None:
        old = self.tree[self.leaves : self.leaves + self.bins]
        self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)
        self.tree[self.leaves : self.leaves + self.bins] = old
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and the offset there."""
        if self.tree[1] < length:
            if self.bins == self.leaves:
                self._grow()
            at = self.leaves + self.bins
            self.bins += 1
            free = self.capacity
        else:
            at = 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] >= length else 2 * at + 1
            free = self.tree[at]
        found = at - self.leaves
        self.tree[at] = free - length
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return found, self.capacity - free


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree = Tournament(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        out[i] = tree.put(lengths[i])
    return out


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, nth (of the rows of this id in its task), start, length, ids_crc32, doc_tokens[, ids]."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        seen: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if len(seen) > SEEN_IDS:
                    seen.clear()
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                rows: list[tuple] = []
                held: list[np.ndarray] = []
                for d, toks in zip(ids, words.encode(texts), strict=True):
                    n = len(toks) + 1
                    nth = seen[d] = seen.get(d, -1) + 1
                    for s in range(0, n, capacity):
                        piece = toks[s : s + capacity]
                        if s + capacity >= n:
                            piece = np.append(piece, np.uint32(END_ID)).astype("<u4")
                        rows.append((d, nth, s, len(piece), zlib.crc32(piece.tobytes()), n))
                        held.append(piece)
                arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in held])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "nth", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = "doc_id long, nth long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a token has a byte at least, so there are no more pieces than this
    groups = max(1, -(-(2 * n + size // capacity) // GROUP_PIECES))
    pieces = pieces_of(docs, path or tokenizer_path(), capacity, with_ids)
    grouped = pieces.withColumn("__g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nth", F.floor(F.col("start") / (16 * capacity))), F.lit(groups)))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def group(t: pa.Table) -> pa.Table:
        of = lambda c: t.column(c).combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        t = t.take(pa.array(np.lexsort((of("ids_crc32"), of("start"), of("nth"), of("doc_id"), -of("length")))))
        placed = np.array(first_fit_decreasing(t.column("length").to_pylist(), capacity), np.int64)
        placed[:, 0] += t.column("__g")[0].as_py() << 32
        out = t.select(cols).append_column("sequence_id", pa.array(placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
        return out.append_column("ids", t.column("ids")) if with_ids else out

    schema = ", ".join(f"{c} long" for c in [*cols, "sequence_id", "offset"]) + ", ids array<int>" * with_ids
    return grouped.groupBy("__g").applyInArrow(group, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pack": op10_pack}
ORACLE: dict[str, str] = {}
