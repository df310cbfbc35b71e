"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, adaptive depth.

Documents with equal shingle sets are one class from the start. A class has a signature of minima and, beside it, an odd
sketch: bit i is the parity of its shingles that hash to i. Two sketches differ in at most as many bits as the sets differ
in shingles, so a pair whose sketches differ in too many bits is ruled out with certainty.

1. Each of the ``TREES`` trees reads the signature from a place of its own on and so has an order of all classes. Classes
   that share its first ``DEPTH`` values are a region; at 0.75 similarity a pair shares a region in none of the trees with
   probability (1 - 0.75**3)**28 = 2e-7. Classes alone in all their regions are done.
2. The members of a region are sorted by the tree's further values, range-partitioned, so that a dense region spreads over
   tasks. Candidates of a class are its neighbour in the order, which has the longest common prefix with it, the first
   of its region, and the first of its part of the region at the depth that the region's density asks for: each doubling
   of a region beyond ``DENSE`` classes adds a value. Candidates that the sketches allow are confirmed on their full
   sets, and confirmed links give components.
3. Regions whose members are still in several components are open. In each of them the classes outside its largest
   component are held against all others, by sketch, in blocks that split dense regions by hash. All pairs of different
   components that the sketches allow are confirmed, whatever a region's size; so no link of a shared region is lost.
   What leaves a block are these pairs alone.

The work of step 3 is (classes outside the largest component) x (classes) in a region, the only part that can grow
faster than the input; a comparison is a few hundred bits. Components are found by hash-min with pointer jumping in
Spark; links, labels and sets stay distributed. Tables written between steps are deleted as soon as they are used up.

Cases: null and blank texts have an empty set, link with nothing and are their own component; fewer than five words are
one shingle; rows of one id are documents of their own, though they share a component id only if linked; null ids count
as larger than all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import base
from .common import FILE_BYTES, WORD, discard, files_for, fresh, partitions, size_of, stored, table
from .shingles import mix, shingle_set
from .vectors import apart

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
TREES, DEPTH, DEEPEST = 28, 3, 12
DENSE = 256
BLOCK = 1024
SKETCH_BITS = 1024

_rng = np.random.default_rng(6)
_A = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima, as 32-bit numbers. Long sets go through in slices."""
    out = np.full(len(_A), ~np.uint64(0))
    for i in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return (mix(out) >> np.uint64(32)).astype("<u4")


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of the set: every bit of every shingle counts."""
    h = mix(shingles * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by place. The places are a power of two of at least four times the shingles, so that few of
    them meet; halving a sketch is to add its halves."""
    bits = max(SKETCH_BITS, 1 << (4 * len(shingles) - 1).bit_length())
    places = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _bits(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, halved to ``size`` bytes."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] > size // 8:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def may_link(differing, n: int, m) -> bool:
    """Whether sets of these sizes that differ in at least so many shingles can reach the threshold."""
    return (DENOMINATOR + NUMERATOR) * differing <= (DENOMINATOR - NUMERATOR) * (n + m)


def regions(sig: np.ndarray) -> np.ndarray:
    """The name of the region of each tree, for signatures in rows."""
    v = sig.reshape(len(sig), TREES, DEPTH).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(sig), TREES)).copy()
    for d in range(DEPTH):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, d])
    return h.view(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, n_shingles, class, signature, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sets = [shingle_set(t, SHINGLE) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([odd_sketch(s) if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "th", "n", "cid", "sig", "odd"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n long, cid long, sig binary, odd binary")


def components(edges: DataFrame, size: int) -> DataFrame:
    """(id, comp): the smallest id that each end of an edge (a, b) reaches. size: bytes of the edges, about; all tables on the
    way are a few times as large at most."""
    files = max(1, -(-4 * size // FILE_BYTES))
    return base.components(edges, lambda df: stored(df, files), discard)


def in_regions(classes: DataFrame) -> DataFrame:
    """(tree, region, cid, m, first) of the regions that more than one class shares: m classes, ``first`` the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, len(_A))
            trees = np.tile(np.arange(TREES, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(regions(sig).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], ["tree", "region", "cid"])

    placed = classes.select("cid", "sig").mapInArrow(run, "tree int, region long, cid long")
    shared = placed.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("first")).where("m > 1")
    return placed.join(shared, "region").select("tree", "region", "cid", "m", "first")


def sorted_orders(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(region, m, first, cid, key) in the trees' orders; key: the tree's values behind the region's own."""
    values = DEEPEST - DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(5).to_pylist()), "<u4").reshape(-1, len(_A))
            at = (b.column(0).to_numpy()[:, None] * DEPTH + np.arange(DEPTH, DEEPEST)) % len(_A)
            keys = np.ascontiguousarray(np.take_along_axis(sig, at, axis=1).astype(">u4"))
            raw = pa.Array.from_buffers(pa.binary(4 * values), len(keys), [None, pa.py_buffer(keys)]).cast(pa.binary()) if len(keys) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(1, 5)], raw], ["region", "m", "first", "cid", "key"])

    met = members.join(apart(classes).select("cid", "sig"), "cid").select("tree", "region", "m", "first", "cid", "sig")
    keyed = met.mapInArrow(run, "region long, m long, first long, cid long, key binary")
    return keyed.repartitionByRange(partitions(members.sparkSession), "region", "key", "cid").sortWithinPartitions("region", "key", "cid")


def candidates(ordered: DataFrame) -> DataFrame:
    """(a, b) of step 2: neighbours in the order, and firsts of regions and of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the row before this batch: region, key, cid, and the first of its part at each depth
        region, key, cid = np.zeros(1, np.int64), np.zeros((1, DEEPEST - DEPTH), ">u4"), np.zeros(1, np.int64)
        firsts, begun = np.zeros(DEEPEST + 1, np.int64), False
        for b in batches:
            if not b.num_rows:
                continue
            m = np.concatenate([[1], b.column(1).to_numpy()])
            star = np.concatenate([cid[-1:], b.column(2).to_numpy()])
            region = np.concatenate([region[-1:], b.column(0).to_numpy()])
            cid = np.concatenate([cid[-1:], b.column(3).to_numpy()])
            key = np.concatenate([key[-1:], np.frombuffer(b"".join(b.column(4).to_pylist()), ">u4").reshape(b.num_rows, -1)])
            same = (region[1:] == region[:-1]) & (begun | (np.arange(len(region) - 1) > 0))
            common = np.where(same, DEPTH + np.cumprod(key[1:] == key[:-1], axis=1).sum(1), 0)
            depth = np.clip(DEPTH + np.ceil(np.log2(np.maximum(m, 1) / DENSE)), DEPTH, DEEPEST).astype(np.int64)
            part, at = np.zeros(len(cid), np.int64), np.arange(len(cid))
            for d in range(DEPTH, DEEPEST + 1):
                begins = np.concatenate([[0], np.where(common < d, at[1:], 0)])
                leads = cid[np.maximum.accumulate(begins)]
                carried = np.maximum.accumulate(begins) == 0  # still the part of the row before this batch
                leads = np.where(carried, firsts[d], leads)
                part = np.where(depth == d, leads, part)
                firsts[d] = leads[-1]
            rows = cid[1:]
            near = cid[:-1][common >= DEPTH], rows[common >= DEPTH]
            x = np.concatenate([near[0], part[1:], star[1:]])
            y = np.concatenate([near[1], rows, rows])
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
            begun = True
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs that the sketches do not rule out."""
    of = lambda x: apart(classes).select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    met = met.where(DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, s, t in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                size = min(len(s), len(t))
                keep.append(may_link(int(np.bitwise_count(_bits([s], size) ^ _bits([t], size)).sum()), n, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the wanted classes, from one document each."""
    one = apart(classes).select("cid", "rep.th", F.col("rep.doc_id").alias("i")).join(wanted.distinct(), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t, SHINGLE).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("__id"), "text")
    met = texts.join(one, (texts["th"] == one["th"]) & texts["__id"].eqNullSafe(one["i"])).select("cid", "text")
    # rows that repeat whole are the only ones that give a class twice
    return met.mapInArrow(run, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, files: int) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    sets = stored(full_sets(docs, classes, ends), files)
    of = lambda x: apart(sets).select(F.col("cid").alias(x), F.col("shingles").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"), files)
    discard(sets)
    return out


def _across(cid: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, odd: list[bytes]) -> np.ndarray:
    """Pairs of different components in one block that the sketches allow, of a row that asks (side 1 or 2) and one that is asked (0 or 2)."""
    out, by = [], {}
    for i, s in enumerate(odd):
        by.setdefault(len(s), []).append(i)
    for size, mine in by.items():
        asks = np.array([i for i in mine if side[i]], np.int64)
        if not len(asks):
            continue
        for other in (size // 2, size, 2 * size):  # sets of less alike sizes cannot link
            asked = np.array([i for i in by.get(other, ()) if side[i] != 1], np.int64)
            if not len(asked):
                continue
            least = min(size, other)
            x, y = _bits([odd[i] for i in asks], least), _bits([odd[i] for i in asked], least)
            for k, i in enumerate(asks):
                far = np.bitwise_count(y ^ x[k]).sum(axis=1, dtype=np.int64)
                hit = asked[may_link(far, n[i], n[asked]) & (comp[asked] != comp[i])]
                out.append(np.stack([np.minimum(cid[i], cid[hit]), np.maximum(cid[i], cid[hit])], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def open_regions(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(region, cid, comp, m, main) of the regions whose members are in several components; main: the one of most members."""
    known = members.select("region", "cid", "m").join(apart(labels).withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = known.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("k"))
    several = sizes.groupBy("region").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("comps > 1")
    return known.join(several.select("region", "main"), "region")


def across_components(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of step 3. A region of more than BLOCK classes is cut into blocks by hash, on both sides."""
    rows = open_regions(members, labels).join(apart(classes).select("cid", "n", "odd"), "cid")
    minor, blocks = F.col("comp") != F.col("main"), F.ceil(F.col("m") / BLOCK).cast("int")
    place = F.pmod(F.xxhash64("cid", "region"), blocks).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), blocks - 1)
    asked = F.transform(every, lambda i: cell(i, F.col("place"), 0))
    asking = F.transform(every, lambda j: cell(F.col("place"), j, 1))
    both = F.array(F.when(minor, cell(F.lit(0), F.lit(0), 2)).otherwise(cell(F.lit(0), F.lit(0), 0)))
    cells = F.when(blocks == 1, both).when(minor, F.concat(asked, asking)).otherwise(asked)
    dealt = rows.withColumn("place", place).withColumn("c", F.explode(cells)).select("region", "c.i", "c.j", "c.side", "cid", "comp", "n", "odd")
    laid = dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            place = np.stack([t.column(i).to_numpy() for i in range(3)], axis=1)
            ends = [*(np.nonzero((place[1:] != place[:-1]).any(axis=1))[0] + 1).tolist(), len(place)]
            side, cid, comp, n = (t.column(i).to_numpy() for i in range(3, 7))
            odd, at, found = t.column(7).to_pylist(), 0, []
            for end in ends:
                found.append(_across(cid[at:end], comp[at:end], n[at:end], side[at:end], odd[at:end]))
                at = end
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # rows from the last cell of this batch on wait for the next one
            place = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            other = np.nonzero((place != place[-1]).any(axis=1))[0]
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and cut == 0 and tuple(held[0].column(i)[0].as_py() for i in range(3)) != tuple(place[0].tolist()):
                yield from compared(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from compared(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from compared(pa.Table.from_batches(held))

    return laid.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame) -> tuple[DataFrame, int]:
    """What ``link`` gives, and how many files a table of its size shall have at most."""
    rows = stored(measured(docs))
    files = files_for(rows)
    classes = stored(
        rows.where("cid is not null").groupBy("cid")
        .agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.min("doc_id").alias("least"), F.min(F.struct("th", "doc_id")).alias("rep")),
        files,
    )
    members = stored(in_regions(classes), files)
    likely = stored(allowed(candidates(sorted_orders(members, classes)), classes), files)
    links = confirmed(likely, docs, classes, files)
    labels = components(links, size_of(links))
    tried = apart(likely)
    left = stored(across_components(members, classes, labels).join(tried, ["a", "b"], "left_anti"), files)
    if left.limit(1).count():
        more = confirmed(left, docs, classes, files)
        if more.limit(1).count():
            # what is known already is a star around each component's least class
            whole = components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more), size_of(labels) + size_of(more))
            discard(labels)
            labels = whole
        discard(more)
    for done in (members, likely, links, left):
        discard(done)
    named = apart(classes).select("cid", "least").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("comp", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = stored(named.select("cid", "component").join(least, "component"), files)
    for done in (classes, labels):
        discard(done)
    out = rows.select("doc_id", "th", "n", "cid").join(of_class, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")), files


def link(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, n_shingles, component (a class name; null for empty sets), component_id, kept."""
    out, files = _linked(docs)
    return out.coalesce(files)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id; rows without words all stay."""
    dk = fresh(docs, "__dk")
    marked = docs.withColumn(dk, F.xxhash64("doc_id", "text"))
    out, files = _linked(docs)
    linked = out.where("component is not null")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
    # the key of a row from its id and text is not in ``link``, but (id, hash of the text) names the same rows
    chosen = first.select(F.col("r.doc_id").alias("__i"), F.col("r.th").alias("__t"))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    named = marked.where(words).withColumns({"__i": F.col("doc_id").cast("long"), "__t": F.xxhash64("text")})
    met = named.join(chosen, (named["__t"] == chosen["__t"]) & named["__i"].eqNullSafe(chosen["__i"]), "left_semi").drop("__i", "__t")
    return met.dropDuplicates([dk]).unionByName(marked.where(~words)).drop(dk).coalesce(max(files, files_for(docs)))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_neardup": op6_neardup}
ORACLE: dict[str, str] = {}
