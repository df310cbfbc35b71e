"""Shared building blocks: tables and fixtures, column groups, distributed running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Derived inputs; each is one SELECT that Spark and DuckDB read alike.
FIXTURES = {
    "fx_missing": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, l_tax,
  l_quantity * 3.0 + (l_partkey % 11) AS y_true,
  CASE WHEN l_partkey % 10 = 3 THEN NULL ELSE l_quantity * 3.0 + (l_partkey % 11) END AS y_mcar,
  CASE WHEN l_quantity > 40 AND l_partkey % 2 = 0 THEN NULL ELSE l_quantity * 3.0 + (l_partkey % 11) END AS y_mar_num,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN NULL ELSE l_quantity * 3.0 + (l_partkey % 11) END AS y_mar_cat,
  CASE WHEN l_suppkey % 3 <> 0 THEN NULL ELSE l_tax END AS y_sparse,
  CASE WHEN l_partkey % 9 = 4 THEN NULL ELSE l_returnflag END AS flag_missing FROM lineitem""",
    "fx_dirty": """SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 50 = 0 THEN -999.0 ELSE c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 40 = 1 THEN 'N/A' WHEN c_custkey % 41 = 2 THEN 'unknown' WHEN c_custkey % 43 = 3 THEN '?' ELSE c_mktsegment END AS seg_sentinel,
  CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS seg_case,
  CASE WHEN c_custkey % 200 = 5 THEN 150 ELSE 20 + c_custkey % 60 END AS cust_age,
  CASE WHEN c_custkey % 100 = 7 THEN -5.0 ELSE (c_custkey % 101) * 1.0 END AS disc_pct,
  CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'a;b' END AS tags,
  CASE WHEN c_custkey % 90 = 0 THEN c_name || 'Ã©' ELSE c_name END AS name_garbled,
  'X' AS constant_col FROM customer""",
    "fx_dupes": "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 100 = 0",
    "fx_near_dupes": """SELECT c_custkey AS rid, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 100000, c_name, c_nationkey, c_acctbal, 'OTHER' FROM customer WHERE c_custkey % 20 = 0""",
    "fx_typed": """SELECT o_orderkey,
  CASE WHEN o_orderkey % 20 = 0 THEN 'N/A' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END AS price_str,
  CASE WHEN o_orderkey % 15 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_str,
  o_orderpriority, o_orderstatus FROM orders""",
    "fx_target": """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate,
  CASE WHEN o_totalprice + (o_custkey % 97) * 1000.0 > 300000 THEN 1 ELSE 0 END AS target,
  CASE WHEN o_totalprice + (o_custkey % 97) * 1000.0 > 300000 THEN 'Y' ELSE 'N' END AS leak_bijection,
  CASE WHEN o_totalprice + (o_custkey % 97) * 1000.0 > 300000 THEN 100.0 ELSE 0.0 END + (o_orderkey % 2) * 0.001 AS leak_near_const,
  o_orderdate + INTERVAL 3 DAY AS ship_date,
  o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 1) AS end_date,
  o_totalprice * 1.01 AS next_order_value FROM orders""",
    "fx_derived": """SELECT l_orderkey, l_partkey, l_quantity, l_tax, l_discount, l_extendedprice,
  l_quantity + l_tax AS d_sum, l_quantity - l_discount AS d_diff, l_quantity * l_discount AS d_prod,
  l_extendedprice / l_quantity AS d_ratio, l_extendedprice * 1.0 + l_tax AS collinear FROM lineitem""",
    "fx_drift": """SELECT event_id, ts, user_id, event_type,
  value + CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' THEN 40.0 ELSE 0.0 END AS value_drift,
  value AS value_stable,
  CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND event_id % 2 = 0 THEN 'error' ELSE event_type END AS type_drift FROM events""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a fixture over the tables."""
    if name in FIXTURES:
        sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in FIXTURES[name]}
        sql = FIXTURES[name]
        for t in sources:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(sql, **sources)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(name: str) -> str:
    """The CTE that makes a fixture known to DuckDB, to be put after ``with``."""
    return f"{name} as ({FIXTURES[name]})"


def over(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(load(spark, sf_dir, name))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def clean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN as null, so that there is one notion of missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def long_form(df: DataFrame, cols: list[str], kind: str = "double") -> DataFrame:
    """(col, v): one row per cell. One pass over the columns asked for."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast(kind).alias("v")) for c in cols])
    return df.select(F.explode(cells).alias("x")).select("x.col", "x.v")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the session's shared folder (where all runs in one process, else one of our own)."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tabquarry-")
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(id, comp): the smallest id that each end of an edge (a, b) reaches, as a table that ``keep`` wrote.

    In each round every end hooks to its least neighbour, pointers jump to their roots, and the edges contract to the roots
    of their ends. Loops and repeats go, so the edges are read whole only once.
    """
    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while labels is None or left.limit(1).count():
        ends = left.select("a", F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("near")))
        roots = keep(ends.groupBy("a").agg(F.min("near").alias("m")).select(F.col("a").alias("id"), F.col("a").alias("old"), F.least("a", "m").alias("comp")))
        while roots.where("comp <> old").limit(1).count():
            further = again(roots).select(F.col("id").alias("comp"), F.col("comp").alias("further"))
            jumped = keep(roots.join(further, "comp").select("id", F.col("comp").alias("old"), F.col("further").alias("comp")))
            drop(roots)
            roots = jumped
        of = lambda x: again(roots).select(F.col("id").alias(x), F.col("comp").alias(f"r_{x}"))  # noqa: E731,B023
        met = left.join(of("a"), "a").join(of("b"), "b").where("r_a <> r_b")
        fewer = keep(met.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct())
        if labels is None:
            moved = keep(roots.select("id", "comp"))
        else:
            moved = keep(labels.join(roots.select(F.col("id").alias("comp"), F.col("comp").alias("further")), "comp", "left").select("id", F.coalesce("further", "comp").alias("comp")))
            drop(labels)
        drop(roots)
        drop(left)
        left, labels = fewer, moved
    drop(left)
    return labels


def bucketed(df: DataFrame, keys: list[str], most: int = 256) -> DataFrame:
    """``df`` with __p, a range of ``keys`` in their order.

    The bounds are literals from a bounded sample (smallest hashes), so that every use of the result, and every retry,
    sees the same ranges; Spark's own range partitioning draws its bounds anew for each plan.
    """
    n = max(1, min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(*keys)
    seen = rows.orderBy(F.xxhash64(*keys)).limit(40 * n).orderBy(*keys).collect() if n > 1 else []  # 40 rows per range
    bounds = sorted({seen[i * len(seen) // n] for i in range(1, n)}, key=lambda r: [(x is not None, x) for x in r]) if seen else []
    kinds = [df.schema[k].dataType for k in keys]
    at = F.struct(*[F.col(k) for k in keys])
    over_bounds = [(at >= F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(r, kinds, keys, strict=True)])).cast("int") for r in bounds]
    return df.withColumn("__p", sum(over_bounds[1:], over_bounds[0]) if over_bounds else F.lit(0))


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums along ``order`` inside ``by``, without one task per group.

    Rows fall into ranges of (by, order); each range sums its own rows, and the totals of the ranges before it, which
    are few, are added. The order must be total, or ties must not matter.
    """
    named = {f"__s{i}": e for i, e in enumerate(sums.values())}
    parted = bucketed(df, [*by, *order]).withColumns(named)
    totals = parted.groupBy(*by, "__p").agg(*[F.sum(c).alias(c) for c in named])
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("__p").alias("__q"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}o") for c in named]
    )
    inside = W.partitionBy(*by, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = parted.withColumns({c: F.sum(c).over(inside) for c in named})
    cond = F.col("__p") == F.col("__q")
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    met = summed.join(offsets, cond, "left")
    return met.select(*df.columns, *[(F.col(c) + F.col(f"{c}o")).alias(name) for name, c in zip(sums, named, strict=True)])


def rank_table(df: DataFrame, col: str, into: str, by: list[str] | None = None) -> DataFrame:
    """Mean rank of each different value, from counts; nulls have none."""
    by = by or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, by, [col], {"__upto": F.col("__n")})
    return ranked.select(*by, col, (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(into))


def average_rank(df: DataFrame, col: str, into: str, by: list[str] | None = None) -> DataFrame:
    """Mean rank of ties, from counts of distinct values; null stays null."""
    return df.join(rank_table(df, col, into, by), [*(by or []), col], "left")


# corrected skewness and kurtosis, as estimators of the population's; null where they are not defined
def skew(c: Column | str) -> Column:
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2))


def kurt(c: Column | str) -> Column:
    n = F.count(c)
    k = F.kurtosis(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1.0) / F.when(n > 3, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * k + 6.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
