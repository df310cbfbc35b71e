"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks; each cell of the grid of blocks scores all its pairs at once and keeps
nothing. Pass by pass a histogram of the scores is narrowed for every query: the counts of a cell, from its highest bin
down to where they reach k (lower bins of it cannot hold the global kth value), are summed over cells, and the bin
that holds the kth score becomes the next range, until it is one integer wide. A last pass emits the scores above that
value and, of those equal to it, the smallest ids as far as there is room, which a ranking then settles.

Scores are integers: components x become floor(64 * x), the score is the inner product. Products are exact in double
precision below 2**53 and in 64-bit integers below 2**62. A vector whose squared length is beyond that is wide: its products are
taken in integers of any size, and a score that a long cannot hold becomes the largest or smallest long.

Cases: see ``vectors.numbered``; vectors of different length are never compared; repeated rows are rows of their own, also as
candidates of each other; fewer than k candidates are all returned; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, partitions, table
from .vectors import apart, numbered

SCALE = 64
BINS = 1024
QUERY_BLOCK, ROW_BLOCK = 4096, 16384
TILE = 1 << 22


def scaled(x: np.ndarray) -> np.ndarray:
    """The scaled vector as 32-bit integers; a wide one as it is, in double precision."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
        return y.astype("<i4") if (y * y).sum() < 2.0**62 else x


def _wide(v: bytes, dim: int) -> list[int]:
    if len(v) == 4 * dim:
        return np.frombuffer(v, "<i4").tolist()
    return [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in np.frombuffer(v, "<f8").tolist()]


def _tiles(q: pa.Table, c: pa.Table, dim: int, exact: bool):
    """(first query of the tile, its scores, what stands for a query's own row: below all scores)."""
    left, right = q.column("vec").to_pylist(), c.column("vec").to_pylist()
    large = [[i for i, v in enumerate(side) if len(v) != 4 * dim] for side in (left, right)]
    kind = np.float64 if exact and not any(large) else np.int64
    never = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    zero = bytes(4 * dim)
    a, b = (np.frombuffer(b"".join(zero if len(v) != 4 * dim else v for v in side), "<i4").reshape(-1, dim).astype(kind) for side in (left, right))
    b = b.T
    own = {u: j for j, u in enumerate(c.column("uid").to_pylist())}
    uids = q.column("uid").to_pylist()
    most = np.iinfo(np.int64).max
    product = lambda v, w: max(-most, min(most, sum(x * y for x, y in zip(v, w, strict=True))))
    step = max(1, TILE // b.shape[1])
    for i in range(0, len(a), step):
        s = a[i : i + step] @ b
        for r in range(len(s)):
            for j in range(len(right)) if i + r in large[0] else large[1]:
                s[r, j] = product(_wide(left[i + r], dim), _wide(right[j], dim))
            if (j := own.get(uids[i + r])) is not None:
                s[r, j] = never
        yield i, s, never


def top_k(vectors: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: condition on the column vec_id that picks the queries."""
    spark = vectors.sparkSession
    rows = numbered(vectors, key, vector, "<i4", scaled)

    def norms(batches):
        for b in batches:
            n = [float((np.frombuffer(v, "<i4").astype(np.float64) ** 2).sum()) if len(v) == 4 * d else 2.0**63 for v, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([max(n, default=0.0)])], ["n"])

    most = rows.select("vec", "dim").mapInArrow(norms, "n double").agg(F.max("n")).first()[0] or 0.0
    # by Cauchy-Schwarz no score reaches ``bound``, a power of two; so all ranges begin at multiples of their bins' width
    bound = 1 << min(63, max(9, math.ceil(most * 1.0001).bit_length()))
    exact = bound <= 2**53
    queries = rows.where(is_query)
    n, n_q = rows.count(), queries.count()
    cols = max(1, math.ceil(n / min(ROW_BLOCK, max(1024, math.ceil(n / partitions(spark))))))
    lines = max(1, math.ceil(n_q / QUERY_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    candidates = rows.withColumns({"col": block(cols), "line": F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))})

    def in_cells(state: DataFrame):
        left = queries.join(state, "uid").withColumns({"line": block(lines), "col": F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))})
        return left.groupBy("line", "col", "dim").cogroup(apart(candidates).groupBy("line", "col", "dim"))

    def histogram(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            low, width, last = (q.column(x).to_numpy() for x in ("low", "width", "last"))
            uids, needs = q.column("uid").to_numpy(), q.column("need").to_numpy()
            for i, s, never in _tiles(q, c, q.column("dim")[0].as_py(), exact):
                sl = slice(i, i + len(s))
                lo, w = low[sl], width[sl]
                r, j = np.nonzero((s >= lo[:, None]) & (s <= last[sl, None]) & (s > never))
                bins = (s[r, j] // w[r] - lo[r] // w[r]).astype(np.int64)
                counts = np.bincount(r * BINS + bins, minlength=len(s) * BINS).reshape(len(s), BINS)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                r, j = np.nonzero((counts > 0) & (above < needs[sl, None]))
                out.append((uids[sl][r], j, counts[r, j]))
        cols3 = [np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in range(3)]
        return pa.table({"uid": pa.array(cols3[0], pa.int64()), "bin": pa.array(cols3[1], pa.int64()), "n": pa.array(cols3[2], pa.int64())})

    width = 2 * bound // BINS
    number = lambda x: F.lit(str(x)).cast("long")
    state = queries.select("uid", number(-bound).alias("low"), number(width).alias("width"), number(bound - 1).alias("last"), F.lit(k).cast("long").alias("need"))
    down = W.partitionBy("uid").orderBy(F.col("bin").desc())
    while True:
        counts = in_cells(state).applyInArrow(histogram, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
        summed = counts.withColumn("upto", F.sum("n").over(down)).join(state, "uid")
        # the bin in which the count from above reaches what is still needed; the lowest range if it never does
        found = summed.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        step = max(1, width // BINS)
        moved = found.select(
            "uid", (F.col("low") + F.col("bin") * F.col("width")).alias("to"), (F.col("need") - F.col("upto") + F.col("n")).alias("left")
        )
        state = cut(
            state.join(moved, "uid", "left").select(
                "uid",
                F.coalesce("to", number(-bound)).alias("low"),
                number(step).alias("width"),
                (F.coalesce("to", number(-bound)) + number(width - 1)).alias("last"),
                F.coalesce("left", "need").alias("need"),
            )
        )
        if width == 1:
            break
        width = step

    def emit(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            c = c.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
            ids, low, need = c.column("vec_id").combine_chunks(), q.column("low").to_numpy(), q.column("need").to_numpy()
            uids, qids = q.column("uid").to_numpy(), q.column("vec_id").to_numpy()
            for i, s, never in _tiles(q, c, q.column("dim")[0].as_py(), exact):
                sl = slice(i, i + len(s))
                r, j = np.nonzero((s >= low[sl, None]) & (s > never))
                tied = s[r, j] == low[sl][r]
                # of a query's ties only the first ids, as many as are needed; rows are in order of id
                starts = np.searchsorted(r, np.arange(len(s)))
                nth = np.cumsum(tied) - tied
                nth -= nth[starts[r]] if len(r) else 0
                keep = ~tied | (nth < need[sl][r])
                r, j = r[keep], j[keep]
                out.append((uids[sl][r], qids[sl][r], ids.take(pa.array(j)), s[r, j].astype(np.int64)))
        names = ("quid", "query_id", "vec_id", "score")
        return pa.table({m: pa.chunked_array([pa.array(o[x], pa.int64()) for o in out], pa.int64()) for x, m in enumerate(names)})

    kept = in_cells(state).applyInArrow(emit, "quid long, query_id long, vec_id long, score long")
    best = W.partitionBy("quid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op4_topk": op4_topk}
ORACLE = {
    "op4_topk": """
with v as (select row_number() over () as uid, vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.uid, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.uid <> c.uid and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by uid order by score desc, vec_id nulls last)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
}
