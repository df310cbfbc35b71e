"""Nearest rows by Euclidean distance, in blocks of space or a grid of bounded blocks, and nearest donors along one number."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import bucketed, components, cut

BLOCK = 8192
#: Points of a block, sampled points at most, and what a bound gives way for distances rounded to nine digits.
POINTS, SAMPLE, SLACK = 1024, 65536, 1e-8


def apart(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _cells(asking: DataFrame, rows: DataFrame, key: str, features: list[str]):
    n_a, n_r = asking.count(), rows.count()
    lines, cols = max(1, math.ceil(n_a / BLOCK)), max(1, math.ceil(n_r / BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vector = F.array(*[F.col(f).cast("double") for f in features])
    left = asking.select(F.col(key).cast("long").alias("key"), vector.alias("x")).withColumns({"line": F.pmod(F.xxhash64("key"), F.lit(lines)).cast("int"), "col": every(cols)})
    right = apart(rows.select(F.col(key).cast("long").alias("key"), vector.alias("x"))).withColumns({"col": F.pmod(F.xxhash64("key"), F.lit(cols)).cast("int"), "line": every(lines)})
    return left.groupBy("line", "col").cogroup(apart(right).groupBy("line", "col"))


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t.column("key").to_numpy(), np.array(t.column("x").to_pylist(), dtype=np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded to nine digits, so that equal distances tie however they were summed.

    With missing coordinates those that both rows have count for all; rows that share none are infinitely far apart.
    """
    d = np.zeros((len(x), len(y)))
    if np.isnan(x).any() or np.isnan(y).any():
        shared = np.zeros(d.shape)
        for j in range(x.shape[1]):
            gap = (x[:, j, None] - y[None, :, j]) ** 2
            shared += ~np.isnan(gap)
            d += np.nan_to_num(gap, nan=0.0)
        return np.where(shared > 0, np.round(np.sqrt(d * (x.shape[1] / np.maximum(shared, 1))), 9), np.inf)
    for j in range(x.shape[1]):
        d += (x[:, j, None] - y[None, :, j]) ** 2
    return np.round(np.sqrt(d), 9)


def nearest_rows(asking: DataFrame, rows: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """(key, other, dist, rank): the k nearest rows of each asking row, itself excluded; ties to the smaller key."""

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and c.num_rows:
            (qk, qx), (ck, cx) = _arrays(q), _arrays(c)
            for i in range(0, len(qk), 256):
                d = _distances(qx[i : i + 256], cx)
                d[qk[i : i + 256, None] == ck[None, :]] = np.inf
                m = min(k, d.shape[1])
                least = np.partition(d, m - 1, axis=1)[:, m - 1]
                r, j = np.nonzero((d <= least[:, None]) & np.isfinite(d))
                o = np.lexsort((ck[j], d[r, j], r))
                r, j = r[o], j[o]
                nth = np.arange(len(r)) - np.searchsorted(r, np.arange(len(d)))[r]
                r, j = r[nth < k], j[nth < k]
                out.append((qk[i : i + 256][r], ck[j], d[r, j]))
        kinds = (("key", pa.int64()), ("other", pa.int64()), ("dist", pa.float64()))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]) if out else [], t) for i, (n, t) in enumerate(kinds)})

    found = _cells(asking, rows, key, features).applyInArrow(best, "key long, other long, dist double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("dist", "other"))).where(F.col("rank") <= k)


# --- complete rows: different points in blocks of space ---------------------------------------------------------------
def _leaves(x: np.ndarray, ids: np.ndarray, tree) -> np.ndarray:
    """The block of each row of ``x`` in a tree of (axis, bound, lower, upper) with block numbers as leaves."""
    out, todo = np.zeros(len(x), np.int64), [(ids, tree)]
    while todo:
        at, t = todo.pop()
        if isinstance(t, int):
            out[at] = t
        elif len(at):
            low = x[at, t[0]] < t[1]
            todo += [(at[low], t[2]), (at[~low], t[3])]
    return out


def _split(x: np.ndarray, leaves: int, names) -> tuple | int:
    """Cuts at medians of the widest axis, until there are ``leaves`` blocks."""
    axis = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
    bound = float(np.median(x[:, axis])) if len(x) else 0.0
    if leaves < 2 or len(x) < 2 or not x[:, axis].min() < bound:
        bound = float(x[:, axis].max()) if len(x) else 0.0
        if leaves < 2 or len(x) < 2 or not x[:, axis].min() < bound:
            return next(names)
    low = x[:, axis] < bound
    return axis, bound, _split(x[low], leaves // 2, names), _split(x[~low], leaves - leaves // 2, names)


class Boxes:
    """What the executors know of the blocks: number, rows and corners of each."""

    def __init__(self, blocks: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.blocks, self.weights, self.lo, self.hi = blocks, weights, lo, hi

    def visits(self, x: np.ndarray, radius: np.ndarray, weigh: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, block) of the boxes that each row's ball reaches. With ``weigh`` those that lie in it whole are left
        out, and their rows are counted for each row of x instead."""
        rows, blocks, inside = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(x), np.int64)
        step = max(1, (1 << 20) // max(1, len(self.blocks)))
        for i in range(0, len(x), step):
            part, r = x[i : i + step], radius[i : i + step, None]
            near, far = np.zeros((len(part), len(self.blocks))), np.zeros((len(part), len(self.blocks)))
            for j in range(x.shape[1]):
                below, above = self.lo[None, :, j] - part[:, j, None], part[:, j, None] - self.hi[None, :, j]
                near += np.maximum(np.maximum(below, above), 0) ** 2
                far += np.minimum(below, above) ** 2
            reached = np.sqrt(near) <= r + SLACK
            if weigh:
                whole = np.sqrt(far) <= r - SLACK
                inside[i : i + step] = whole @ self.weights
                reached &= ~whole
            a, b = np.nonzero(reached)
            rows.append(a + i)
            blocks.append(self.blocks[b])
        return np.concatenate(rows), np.concatenate(blocks), inside


class Points:
    """The different points of complete rows, in blocks of about POINTS points.

    ``table``: pid, x, w (its rows), block. A bounded sample shapes the blocks; every point is in one. Equal rows are one
    point, so that no point is a large group.
    """

    def __init__(self, rows: DataFrame, key: str, features: list[str], points: DataFrame | None = None) -> None:
        self.source, self.key, self.features = rows, key, features
        self.rows = rows.select(F.col(key).cast("long").alias("key"), F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features]).alias("x"))
        if points is None:
            points = cut(self.rows.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn("pid", F.monotonically_increasing_id()))
        leaves, d = max(1, math.ceil(points.count() / POINTS)), len(features)
        seen = points.orderBy(F.xxhash64("x")).limit(min(SAMPLE, 64 * leaves)).select("x").collect()  # bounded; shapes the blocks only
        tree = _split(np.array([r["x"] for r in seen], dtype=np.float64).reshape(-1, d), leaves, itertools.count())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), d)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_leaves(x, np.arange(len(x)), tree))], ["pid", "x", "w", "block"])

        self.table = cut(points.select("pid", "x", "w").mapInArrow(place, "pid long, x array<double>, w long, block long"))
        ends = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
        found = np.array([tuple(r) for r in self.table.groupBy("block").agg(F.sum("w"), *ends).collect()], dtype=np.float64).reshape(-1, 2 + 2 * d)  # a row per block
        self.boxes = Boxes(found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), found[:, 2 : 2 + d], found[:, 2 + d :])

    def of_rows(self) -> DataFrame:
        """(key, pid) of every row."""
        return self.rows.join(apart(self.table).select("x", "pid"), "x").select("key", "pid")

    def only(self, pids: DataFrame) -> Points:
        return Points(self.source, self.key, self.features, self.table.join(pids, "pid", "left_semi"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _columns(t: pa.Table, d: int, *names: str) -> list[np.ndarray]:
    """x as a matrix and further columns."""
    x = [_matrix(c, d) for c in t.column("x").chunks]
    return [np.concatenate(x) if x else np.zeros((0, d)), *[t.column(c).to_numpy() for c in names]]


def _by_block(df: DataFrame):
    """Blocks are little data and much work, so they are dealt to a fixed number of tasks that are not joined again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").groupBy("block")


def within(points: Points, eps: float, asked: Points | None = None) -> DataFrame:
    """(pid, n): how many rows of ``asked``, else of its own table, lie within eps of each point; points without any may be left out."""
    asked, d = asked or points, len(points.features)
    boxes = asked.boxes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            at, block, inside = boxes.visits(x, np.full(len(x), eps), weigh=True)
            sure = np.nonzero(inside)[0]
            rows, blocks = pa.array(np.concatenate([at, sure])), pa.array([*block.tolist(), *[None] * len(sure)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), blocks, pa.array(np.concatenate([np.zeros(len(at), np.int64), inside[sure]]))], ["pid", "x", "block", "n"])

    def count(q: pa.Table, c: pa.Table) -> pa.Table:
        (qx, qp), (cx, cw) = _columns(q, d, "pid"), _columns(c, d, "w")
        ns = [(_distances(qx[i : i + 256], cx) <= eps) @ cw for i in range(0, len(qp), 256)]
        return pa.table({"pid": pa.array(qp, pa.int64()), "n": pa.array(np.concatenate(ns) if ns else [], pa.int64())})

    asking = cut(points.table.select("pid", "x").mapInArrow(ask, "pid long, x array<double>, block long, n long"))
    met = _by_block(asking.where("block is not null")).cogroup(_by_block(apart(asked.table))).applyInArrow(count, "pid long, n long")
    return met.unionByName(asking.where("block is null").select("pid", "n")).groupBy("pid").agg(F.sum("n").alias("n"))


def clusters_within(points: Points, eps: float) -> DataFrame:
    """(pid, cluster): points that are reached from each other in steps of at most eps have one number.

    Points of one cell, whose diagonal is below eps, belong together; cells are linked if any two of their points are
    within eps. So links follow the cells, not the pairs of rows.
    """
    d, boxes = len(points.features), points.boxes
    side = (eps - SLACK) / math.sqrt(d)
    at = F.transform("x", lambda v: F.floor(v / F.lit(side))) if side > SLACK else F.array("pid")
    named = cut(points.table.withColumn("at", at))
    placed = cut(named.join(apart(named).groupBy("at").agg(F.min("pid").alias("cell")), "at").select("pid", "x", "block", "cell"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), d)
            at, block, _ = boxes.visits(x, np.full(len(x), eps))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(block)], ["x", "cell", "block"])

    def links(q: pa.Table, c: pa.Table) -> pa.Table:
        (qx, qc), (cx, cc) = _columns(q, d, "cell"), _columns(c, d, "cell")
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(qx), 256):
            a, b = np.nonzero(_distances(qx[i : i + 256], cx) <= eps)
            a, b = qc[i : i + 256][a], cc[b]
            found.append(np.unique(np.stack([a, b], axis=1)[a < b], axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    asking = placed.select("x", "cell").mapInArrow(ask, "x array<double>, cell long, block long")
    edges = _by_block(asking).cogroup(_by_block(apart(placed))).applyInArrow(links, "a long, b long")
    labels = components(edges).select(F.col("id").alias("cell"), "comp")
    return placed.select("pid", "cell").join(labels, "cell", "left").select("pid", F.coalesce("comp", "cell").alias("cluster"))


def nearest_to_points(points: Points, k: int) -> DataFrame:
    """(pid, other, opid, dist): the k rows nearest to each point, its own rows among them; ties to the smaller key.

    The rows in a point's own block bound the distance; then every block whose box is not farther is searched.
    """
    d, boxes = len(points.features), points.boxes
    first = points.rows.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("key"))).where(F.col("r") <= k)
    heads = first.groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # at most k of a point can count
    table = cut(points.table.join(heads, "x").select("pid", "x", "block", "keys", F.size("keys").cast("long").alias("n")))

    def reach(t: pa.Table) -> pa.Table:
        x, pid, n = _columns(t, d, "pid", "n")
        radius = np.full(len(pid), np.inf)
        m = min(k, len(pid))
        for i in range(0, len(pid), 256):
            dist = _distances(x[i : i + 256], x)
            part = np.argpartition(dist, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(dist, part, axis=1)
            order = np.argsort(near, axis=1)
            near, upto = np.take_along_axis(near, order, axis=1), np.cumsum(n[np.take_along_axis(part, order, axis=1)], axis=1)
            radius[i : i + 256] = np.where(upto >= k, near, np.inf).min(1)
        at, block, _ = boxes.visits(x, radius)
        return pa.table({"pid": pid[at], "x": pa.array(list(x[at]), pa.list_(pa.float64())), "block": block})

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and c.num_rows:
            (qx, qp), (cx, cp, size) = _columns(q, d, "pid"), _columns(c, d, "pid", "n")
            flat, begins = np.concatenate([v.flatten().to_numpy() for v in c.column("keys").chunks]), np.cumsum(size) - size
            for i in range(0, len(qp), 256):
                dist = _distances(qx[i : i + 256], cx)
                m = min(k, len(cp)) - 1
                r, j = np.nonzero(dist <= np.partition(dist, m, axis=1)[:, m, None])
                n = size[j]
                each = np.repeat(np.arange(len(j)), n)
                keys = flat[begins[j][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
                r, j, v = r[each], j[each], dist[r, j][each]
                o = np.lexsort((keys, v, r))
                r, j, v, keys = r[o], j[o], v[o], keys[o]
                keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(dist)))[r] < k
                out.append((qp[i : i + 256][r[keep]], keys[keep], cp[j[keep]], v[keep]))
        return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("pid", "other", "opid", "dist"))})

    asking = _by_block(table.select("pid", "x", "block", "n")).applyInArrow(reach, "pid long, x array<double>, block long")
    found = _by_block(asking).cogroup(_by_block(apart(table))).applyInArrow(best, "pid long, other long, opid long, dist double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy("dist", "other"))).where(F.col("rank") <= k).drop("rank")


def nearest_donor(df: DataFrame, key: str, at: str, value: str, into: str) -> DataFrame:
    """For each row the value of the donor (row with a value) nearest along ``at``; ties to the smaller key.

    Rows fall into ranges of ``at``; a donor may also lie in a range before or behind, so each range's first and last
    donors are handed on. No window spans the table.
    """
    donors = df.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(at).alias("__at")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("__d"))
    donors = donors.select("__at", F.struct(F.col("__at").alias("at"), "__d.k", "__d.v").alias("__donor"))
    rows = df.where(F.col(at).isNotNull()).select(F.col(at).alias("__at"), F.lit(None).cast(donors.schema["__donor"].dataType).alias("__donor")).distinct()
    both = bucketed(donors.unionByName(rows), ["__at"])
    inside = W.partitionBy("__p").orderBy("__at")
    near = both.withColumns({
        "__lo": F.last("__donor", ignorenulls=True).over(inside.rangeBetween(W.unboundedPreceding, 0)),
        "__hi": F.first("__donor", ignorenulls=True).over(inside.rangeBetween(0, W.unboundedFollowing)),
    }).where("__donor is null")
    ends = both.groupBy("__p").agg(F.min("__donor").alias("first"), F.max("__donor").alias("last"))
    order = W.orderBy("__p")  # a row per range
    handed = ends.select("__p", F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.first("first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("__behind"))
    met = near.join(handed, "__p", "left").withColumns({"__lo": F.coalesce("__lo", "__before"), "__hi": F.coalesce("__hi", "__behind")})
    gap = lambda s: F.abs(F.col(f"{s}.at") - F.col("__at"))
    low = F.col("__hi").isNull() | (gap("__lo") < gap("__hi")) | ((gap("__lo") == gap("__hi")) & (F.col("__lo.k") <= F.col("__hi.k")))
    picked = met.select("__at", F.when(F.col("__lo").isNotNull() & low, F.col("__lo.v")).otherwise(F.col("__hi.v")).alias(into))
    return df.join(picked, df[at] == picked["__at"], "left").drop("__at")
