"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the unit vectors on a few random directions, shifts and quantises them, and takes the position on a
Hilbert curve as key. Spark range-partitions the keys and so gives each vector a rank on each curve. A query looks at
the key windows around its rank on every curve; the windows' candidates are reranked by exact cosine and merged.

The index covers every row. How wide the windows are, and how many curves are used, is measured: for at most
``PROBES`` queries (smallest hashes; a bounded sample) the true neighbours are found by brute force against all rows, and
their distances in rank give the window that finds the share ``RECALL`` of them, for each number of curves; the
cheapest combination is used. So data without structure, for which no ordering helps, get wide windows instead of
wrong results, and clustered data narrow ones.

Cases: see ``vectors.numbered``; zero vectors take no part; vectors of different length are never compared; repeated
rows are rows of their own; ties go to the smaller id; fewer than k candidates are all returned; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, partitions, table
from .vectors import apart, matrix, numbered

CURVES, AXES, BITS = 6, 6, 8
PROBES, RECALL = 256, 0.96
BLOCK = 2048
SEED = 11
TILE = 1 << 21


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows), by Skilling's transform, for all points at once."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one curve."""
    rng = np.random.default_rng((SEED, curve, unit.shape[1]))
    directions, _ = np.linalg.qr(rng.normal(size=(unit.shape[1], min(axes, unit.shape[1]))))
    spread = 4 / math.sqrt(unit.shape[1])
    at = (unit @ directions + spread) / (2 * spread) * 0.75 + rng.uniform(0, 0.25, directions.shape[1])
    return hilbert(np.clip((at * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def nonzero(x: np.ndarray) -> np.ndarray | None:
    n = np.sqrt((x * x).sum())
    return x if n > 0 and np.isfinite(n) else None


def _units(t, dim: int) -> np.ndarray:
    v = matrix(t.column("vec"), "<f8", dim)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _nearest(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    """For each query of a block the best k of the block's candidates. Scores are computed row by row for all that may
    be among them, so equal vectors get equal scores wherever they stand."""
    out: list[tuple[np.ndarray, ...]] = []
    if q.num_rows and c.num_rows:
        dim = q.column("dim")[0].as_py()
        a, b = matrix(q.column("vec"), "<f8", dim), matrix(c.column("vec"), "<f8", dim)
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        ua, ub = a / na[:, None], (b / nb[:, None]).T
        own = {u: j for j, u in enumerate(c.column("uid").to_pylist())}
        cu, qu, qi = c.column("uid").to_numpy(), q.column("uid").to_numpy(), q.column("vec_id").to_numpy()
        named = c.column("vec_id").combine_chunks()
        ci = named.fill_null(np.iinfo(np.int64).max).to_numpy()  # no id comes last in ties
        step = max(1, TILE // len(b))
        for i in range(0, len(a), step):
            s = ua[i : i + step] @ ub
            for r in range(len(s)):
                j = own.get(qu[i + r])
                if j is not None:
                    s[r, j] = -np.inf
                m = min(k, s.shape[1] - (j is not None))
                if not m:
                    continue
                least = np.partition(s[r], -m)[-m]
                near = np.nonzero(s[r] >= least - 1e-9)[0]
                near = near[s[r, near] > -np.inf]
                exact = (b[near] * a[i + r]).sum(1) / (nb[near] * na[i + r])
                best = np.lexsort((cu[near], ci[near], -exact))[:m]
                near = near[best]
                out.append((np.full(m, qu[i + r]), np.full(m, qi[i + r]), cu[near], named.take(pa.array(near)), exact[best]))
    names, kinds = ("quid", "query_id", "uid", "vec_id", "score"), (pa.int64(),) * 4 + (pa.float64(),)
    return pa.table({x: pa.chunked_array([pa.array(o[n], kinds[n]) for o in out], kinds[n]) for n, x in enumerate(names)})


NEAREST = "quid long, query_id long, uid long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("quid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` on each curve, with its rank there: uid, curve, rank."""
    spark = rows.sparkSession

    def keys(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                unit, uids = _units(part, int(d)), part.column("uid")
                for curve in range(CURVES):
                    yield pa.RecordBatch.from_arrays([uids, pa.array(np.full(len(uids), curve), pa.int32()), pa.array(curve_keys(unit, curve))], ["uid", "curve", "key"])

    keyed = rows.select("uid", "dim", "vec").mapInArrow(keys, "uid long, curve int, key long")
    parted = keyed.repartitionByRange(partitions(spark), "curve", "key", "uid").sortWithinPartitions("curve", "key", "uid")
    laid = cut(parted.select("uid", "curve", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(starts or [(0, 0)], "p long, start long")
    at = F.col("start") + F.col("at") - F.shiftleft(F.col("p"), 33)
    return laid.withColumn("p", part).join(offsets, "p").select("uid", "curve", (at - F.col("curve") * n).alias("rank"))


def nearest(vectors: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: condition on the column vec_id that picks the queries."""
    spark = vectors.sparkSession
    rows = numbered(vectors, key, vector, "<f8", nonzero)
    queries, n = rows.where(is_query), rows.count()
    ranks = cut(ranked(rows, n))
    curves, window = calibrated(rows, queries, ranks, n, k, recall)

    used = ranks.where(F.col("curve") < curves)
    blocks = F.floor(F.col("rank") / BLOCK)
    members = used.withColumn("block", blocks).join(rows, "uid")
    first, last = F.greatest(F.lit(0), F.floor((F.col("rank") - window) / BLOCK)), F.least(F.lit(max(0, n - 1) // BLOCK), F.floor((F.col("rank") + window) / BLOCK))
    asking = used.join(queries, "uid").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    keys = ["curve", "block", "dim"]
    found = asking.groupBy(*keys).cogroup(apart(members).groupBy(*keys)).applyInArrow(lambda q, c: _nearest(q, c, k), NEAREST)
    return _best(found.distinct(), k).select("query_id", "rank", "vec_id", "score")


def calibrated(rows: DataFrame, queries: DataFrame, ranks: DataFrame, n: int, k: int, recall: float) -> tuple[int, int]:
    """(number of curves, window in ranks) that finds the share ``recall`` of the probes' true neighbours most cheaply."""
    probes = queries.orderBy(F.xxhash64(F.lit(SEED), "uid")).limit(PROBES).toArrow()  # bounded: PROBES vectors
    if not probes.num_rows or n < 2:
        return CURVES, BLOCK
    probes = probes.replace_schema_metadata(None)
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def brute(batches):
        for b in batches:
            for d in set(b.column("dim").to_pylist()):
                c = pa.Table.from_batches([b.filter(pa.array(b.column("dim").to_numpy() == d))])
                q = shared.value.filter(pa.array(shared.value.column("dim").to_numpy() == d))
                yield from _nearest(q, c, k).to_batches()

    true = _best(rows.mapInArrow(brute, NEAREST), k).select("quid", "uid")
    of_query = ranks.select(F.col("uid").alias("quid"), "curve", F.col("rank").alias("qrank"))
    gaps = true.join(ranks, "uid").join(of_query, ["quid", "curve"]).select("quid", "uid", "curve", F.abs(F.col("rank") - F.col("qrank")).alias("gap"))
    held = gaps.groupBy("quid", "uid").pivot("curve", list(range(CURVES))).agg(F.first("gap")).toPandas()  # PROBES x k rows
    least = np.minimum.accumulate(held[[str(c) for c in range(CURVES)]].to_numpy(dtype=np.float64), axis=1)
    options = []
    for c in range(2, CURVES + 1):
        w = int(np.quantile(least[:, c - 1], recall)) + 1
        options.append((c * min(n, 2 * w + BLOCK), c, w))
    return min(options)[1:]


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op5_neighbours": op5_neighbours}
ORACLE: dict[str, str] = {}
