"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays over content-dealt shards.

A window is ``WIDTH`` bytes of a text. It is removed if the same bytes start anywhere else, in another text or the same.

1. Anchors: a window's anchor is the smallest hash among its KGRAM-byte strings, so equal windows have equal anchors
   wherever they stand. Each stretch of at most PIECE windows with one anchor is a segment; segments, not texts, are dealt by
   anchor. Equal segments are counted as one before they are moved.
2. Segments whose anchor occurs only once cannot hold a repeated window and end here. Those that occur more than once
   but are all equal are repeated as a whole. The distinct segments of the other anchors are sent with their bytes
   to shards of about SHARD bytes; there the suffix array is induced and its common prefixes tell, with the counts, which
   windows are repeated.
3. An anchor whose distinct segments hold more than HOT bytes is dealt again: they are texts, each counted as often as it
   occurs, that go through the same steps with anchors of another hash over shorter strings. Windows that differ outside
   the string they share part ways, level by level, until all anchors fit.
4. Repeated windows of each distinct segment go back to all its places, and each text drops the bytes they cover.

A long run of one byte, or of few, is cut into pieces that are mostly equal, so it counts as few segments. Anchors and names
of segments are 64-bit hashes; which windows are equal is decided by the suffix arrays. Cases: a null text is empty; texts
below WIDTH bytes and empty ones keep all bytes; very long texts are read in slices; repeated rows are texts of their own, so
they remove each other; ids may be null or repeated; an empty table gives no rows; further columns pass through
``strip_repeats``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, partitions, stored, table
from .shingles import mix, prefix_sums, range_hashes
from .suffixes import repeated_windows

WIDTH, KGRAM = 400, 200
SLICE = 1 << 20
PIECE = 512
SHARD, HOT = 2 << 20, 1 << 20
LEVELS = 24

SEGMENT = "v long, hs long, s0 int, nw int, again boolean"


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """Least or largest of each ``width`` neighbours, by doubling."""
    n, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[:n], x[width - w : width - w + n])


def _segments(raw: bytes, base: int, level: int) -> list[np.ndarray]:
    gram = KGRAM if level == 0 else KGRAM // 2
    span = WIDTH - gram + 1  # k-grams of a window
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = range_hashes(sums, at, at + gram)
    if level:
        grams = mix(grams + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
    least = _sliding(grams, span, np.minimum)
    begins = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    lengths = np.diff(np.append(begins, len(least)))
    pieces = -(-lengths // PIECE)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begins, pieces) + nth * PIECE
    ends = np.append(starts[1:], len(least))
    v = least[starts]
    hs = range_hashes(sums, starts, ends - 1 + WIDTH)
    # a segment can repeat within itself only if its anchor occurs in it twice
    pad = np.zeros(span - 1, np.uint64)
    places = np.nonzero(_sliding(np.concatenate([pad, least, pad]), span, np.maximum) == grams)[0]
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, ends + span - 1)
    count = hi - lo
    idx = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    which = np.repeat(np.arange(len(starts)), count)
    hits = np.bincount(which, weights=grams[places[idx]] == v[which], minlength=len(starts))
    return [v.view(np.int64), hs.view(np.int64), (starts + base).astype(np.int32), (ends - starts).astype(np.int32), hits > 1]


def segments(raw: bytes, level: int = 0) -> list[np.ndarray] | None:
    """v (anchor), hs (hash of the bytes), s0, nw (first window and number of windows), again (may repeat within)."""
    if len(raw) < WIDTH:
        return None
    last = len(raw) - WIDTH
    parts = [_segments(raw[i : min(i + SLICE, last + 1) + WIDTH - 1], i, level) for i in range(0, last + 1, SLICE)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """dk, raw, c: rows with equal id and text share a key and a fate; each counts once."""
    return docs.select(F.xxhash64("doc_id", "text").alias("dk"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.lit(1).cast("long").alias("c"))


def measured(texts: DataFrame, level: int) -> DataFrame:
    """dk, c and the segments as packed columns, one row per text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts, packed = [], [], []
            for k, raw, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (s := segments(raw, level)) is not None:
                    keys.append(k)
                    counts.append(c)
                    packed.append([x.tobytes() for x in s])
            cols = list(zip(*packed, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), *[pa.array(x, pa.binary()) for x in cols]], ["dk", "c", "v", "hs", "s0", "nw", "again"])

    return texts.select("dk", "raw", "c").mapInArrow(run, "dk long, c long, v binary, hs binary, s0 binary, nw binary, again binary")


_KINDS = (("v", np.int64), ("hs", np.int64), ("s0", np.int32), ("nw", np.int32), ("again", np.bool_))


def unpacked(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.frombuffer(b"".join(b.column(i + 2).to_pylist()), k) for i, (_, k) in enumerate(_KINDS)]
            each = [len(x) // 8 for x in b.column(2).to_pylist()]
            keys, counts = (np.repeat(b.column(i).to_numpy(), each) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), *[pa.array(c) for c in cols]], ["dk", "c", *[m for m, _ in _KINDS]])

    return packed.mapInArrow(run, f"dk long, c long, {SEGMENT}")


def _ranges(mask: np.ndarray) -> bytes:
    """Stretches of true as pairs of 32-bit numbers (from, to)."""
    edges = np.nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))[0]
    return edges.astype("<i4").tobytes()


def _shard(t: pa.Table) -> pa.Table:
    """Repeated windows of the segments of one shard."""
    first: dict[tuple[int, int], int] = {}
    for i, k in enumerate(zip(t.column("v").to_pylist(), t.column("hs").to_pylist(), strict=True)):
        first.setdefault(k, i)
    rows = t.take(list(first.values()))
    raws, counts = rows.column("raw").to_pylist(), rows.column("c").to_pylist()
    joined = np.frombuffer(b"".join(r + b"\xff" for r in raws), np.uint8)  # no byte of UTF-8
    found = repeated_windows(joined, WIDTH)
    at, out = 0, []
    for r, c in zip(raws, counts, strict=True):
        n = len(r) - WIDTH + 1
        out.append(_ranges(np.ones(n, bool) if c > 1 else found[at : at + n]))
        at += len(r) + 1
    return pa.table({"v": rows.column("v"), "hs": rows.column("hs"), "ranges": pa.array(out, pa.binary())})


def repeats(texts: DataFrame, level: int = 0) -> DataFrame:
    """(dk, found): for each of the texts (dk, raw, c) with repeated windows its list of (s0, nw, ranges of windows from s0; null: all)."""
    spark = texts.sparkSession
    packed = stored(measured(texts, level))
    same = stored(unpacked(packed).groupBy("v", "hs").agg(F.sum("c").alias("c"), F.max("again").alias("again"), F.min(F.struct("dk", "s0", "nw")).alias("rep")))
    size = F.col("rep.nw") + (WIDTH - 1)
    anchors = same.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("bytes"), F.max("again").alias("again"), F.max("c").alias("most"))
    # an anchor of one segment that occurs once and holds the anchor once repeats nothing
    live = anchors.where("most > 1 or kinds > 1 or again").select("v", F.expr("kinds > 1 or again").alias("search"), "bytes")
    kept = stored(same.join(live, "v").select("v", "hs", "c", "search", "bytes", "rep.dk", "rep.s0", "rep.nw"))
    discard(same)
    hot = F.col("search") & (F.col("bytes") > HOT) & F.lit(level < LEVELS)
    total = kept.where(F.col("search") & ~hot).agg(F.sum(F.col("nw") + WIDTH)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD), min(partitions(spark), math.ceil(16 * total / SHARD)))

    wanted = kept.where("search").groupBy("dk").agg(F.collect_list(F.struct("v", "hs", "c", hot.cast("int").alias("hot"), "s0", "nw")).alias("parts"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = [[p[x] for p in parts] for x in ("v", "hs", "c", "hot")]
                bytes_of = [raw[p["s0"] : p["s0"] + p["nw"] - 1 + WIDTH] for p in parts]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(bytes_of, pa.binary())], ["v", "hs", "c", "hot", "raw"])

    sent = texts.select("dk", "raw").join(wanted, "dk").select("raw", "parts").mapInArrow(slices, "v long, hs long, c long, hot long, raw binary")
    dealt = sent.where("hot = 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(_shard, "v long, hs long, ranges binary")
    whole = kept.where("not search").select("v", "hs", F.lit(None).cast("binary").alias("ranges"))
    result = found.unionByName(whole)
    if kept.where(hot).limit(1).count():
        again = stored(sent.where("hot = 1").groupBy("v", "hs").agg(F.first("c").alias("c"), F.first("raw").alias("raw")))
        inner = repeats(again.select(F.xxhash64("v", "hs").alias("dk"), "raw", "c"), level + 1)
        result = result.unionByName(again.select("v", "hs", F.xxhash64("v", "hs").alias("dk")).join(inner, "dk").mapInArrow(_flattened, "v long, hs long, ranges binary"))
    places = unpacked(packed).select("dk", "v", "hs", "s0", "nw").join(result, ["v", "hs"]).where("ranges is null or octet_length(ranges) > 0")
    # rows of equal id and text have the same places; each is listed once
    return places.groupBy("dk").agg(F.collect_set(F.struct("s0", "nw", "ranges")).alias("found"))


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows found within a segment (dk, v, hs, found) as stretches of its own."""
    for b in batches:
        out = []
        for found in b.column(3).to_pylist():
            stretches = sorted((f["s0"] + x, f["s0"] + y) for f in found for x, y in ([(0, f["nw"])] if f["ranges"] is None else np.frombuffer(f["ranges"], "<i4").reshape(-1, 2).tolist()))
            out.append(np.array(stretches, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary())], ["v", "hs", "ranges"])


def _kept_bytes(raw: bytes, found: list) -> tuple[bytes, int]:
    """(what is left, number of removed stretches)."""
    change = np.zeros(len(raw) + 1, np.int32)
    for f in found or ():
        r = np.array([0, f["nw"]]) if f["ranges"] is None else np.frombuffer(f["ranges"], "<i4")
        np.add.at(change, f["s0"] + r[::2], 1)
        np.add.at(change, f["s0"] + r[1::2] + WIDTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), spans


def _marked(docs: DataFrame) -> DataFrame:
    dk = fresh(docs, "__dk")
    found = repeats(_keyed(docs)).withColumnsRenamed({"dk": dk, "found": fresh(docs, "__found")})
    return docs.withColumn(dk, F.xxhash64("doc_id", "text")).join(found, dk, "left")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                left, spans = _kept_bytes(raw, f) if f else (raw, 0)
                for c, x in zip(out, (len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _marked(docs).select("doc_id", "text", "__found").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts without the repeated bytes; a letter that loses some of its bytes goes as a whole."""
    rest, new, found = fresh(docs, "__row"), fresh(docs, "__new"), fresh(docs, "__found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not f else _kept_bytes(t.encode("utf-8", "surrogatepass"), f)[0].decode("utf-8", "ignore") for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], [new, rest])

    others = [c for c in docs.columns if c.lower() != "text"]
    whole = _marked(docs).select("text", found, F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in others]).alias(rest))
    done = whole.mapInArrow(run, f"`{new}` string, `{rest}` {whole.schema[rest].dataType.simpleString()}")
    return done.select(*[F.col(new).alias(c) if c.lower() == "text" else F.col(f"{rest}.`{c}`") for c in docs.columns])


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substrings": op3_substrings}
ORACLE: dict[str, str] = {}
