"""Feature engineering, encoding, transforms, feature selection, PCA: fitted on one frame, reusable on others.

Every step is fit(df) -> parameters and transform(df, parameters) -> df, so that what was learned on the training split
applies unchanged to the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import FIXTURES, clean, cut, duck, numeric_columns, over, running
from .relations import pearson

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "nunique": F.count_distinct}
SMOOTHING, HASH_COLUMNS = 10.0, 8
MAX_CATEGORIES = 10_000


@dataclass
class Step:
    """A fitted step: its kind, name and columns, and what fitting found."""

    kind: str
    name: str
    columns: list[str]
    params: dict = field(default_factory=dict)


def _one(df: DataFrame, *aggs):
    return df.agg(*aggs).first()  # one row


def categories(df: DataFrame, col: str) -> list:
    """Sorted distinct values; an error beyond ``MAX_CATEGORIES``, as a column per value would not be usable."""
    out = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(MAX_CATEGORIES + 1).collect()]
    if len(out) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} categories")
    return out


def lookup(df: DataFrame, table: DataFrame, col: str, value: str, into: str) -> DataFrame:
    """Left join on one key; the optimizer broadcasts the table if it is small."""
    t = table.select(F.col(col).alias("__k"), F.col(value).alias("__v"))
    return df.join(t, F.col(col) == F.col("__k"), "left").withColumn(into, F.col("__v")).drop("__k", "__v")


# --- engineering --------------------------------------------------------------------------------------------------
def engineer(df: DataFrame, name: str, op: str, src: list[str], params: dict | None = None) -> DataFrame:
    p, c = params or {}, [F.col(s) for s in src]
    if op == "sum":
        return df.withColumn(name, sum((F.coalesce(x.cast("double"), F.lit(0.0)) for x in c), F.lit(0.0)))
    if op == "ratio":
        return df.withColumn(name, F.coalesce(F.try_divide(c[0].cast("double"), c[1].cast("double")), F.lit(0.0))) if len(c) == 2 else df
    if op == "indicator":
        return df.withColumn(name, F.coalesce(c[0] == F.lit(p.get("threshold", 1)), F.lit(False)).cast("byte"))
    if op == "bin":
        q = p.get("edges") or quantile_edges(df, src[0], int(p.get("bins", 4)))
        if len(q) < 2:
            return df.withColumn(name, F.lit(None).cast("int"))
        x, out = c[0].cast("double"), F.lit(None).cast("int")
        for i in range(len(q) - 1, 0, -1):
            out = F.when(x <= q[i], i - 1).otherwise(out)
        return df.withColumn(name, F.when(x >= q[0], out))
    if op == "extract":
        return df.withColumn(name, F.nullif(F.regexp_extract(c[0], p.get("pattern", r"^([A-Za-z]+)"), 1), F.lit("")))
    if op == "polynomial":
        squares = {f"{s}_sq": F.col(s) * F.col(s) for s in src}
        return df.withColumns(squares | {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(src) for b in src[i + 1 :]})
    if op == "datetime":
        parts = {"year": F.year, "month": F.month, "day": F.day, "dayofweek": F.weekday, "hour": F.hour}
        return df.withColumns({f"{name}_{k}": parts[k](c[0]) for k in p.get("parts", list(parts))})
    if op == "log":
        return df.withColumn(name, F.log1p(c[0]))
    if op == "multiply":
        return df.withColumn(name, c[0] * c[1]) if len(c) == 2 else df
    if op in ("groupby_agg", "count"):
        return lookup(df, p.get("table") or group_table(df, op, src, p), src[0], "__a", name)
    if op == "reciprocal":
        return df.withColumn(name, 1.0 / (c[0] + 1e-8))
    raise ValueError(f"unknown operation {op!r}")


def group_table(df: DataFrame, op: str, src: list[str], params: dict) -> DataFrame:
    """What groupby_agg and count look up: a row per group."""
    agg = F.count(F.lit(1)) if op == "count" else AGGREGATES[params.get("agg_func", "mean")](src[1])
    return df.where(F.col(src[0]).isNotNull()).groupBy(src[0]).agg(agg.alias("__a"))


def quantile_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    q = _one(df, F.percentile(F.col(col).cast("double"), F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("q"))["q"]
    return sorted(set(q)) if q else []


# --- encoding -----------------------------------------------------------------------------------------------------
def fit_encoder(df: DataFrame, col: str, method: str, target: str | None = None, order: list | None = None) -> Step:
    known = df.where(F.col(col).isNotNull())
    p: dict = {}
    if method in ("label", "onehot", "binary"):
        p["values"] = categories(df, col)
    elif method == "ordinal":
        p["values"] = list(order or categories(df, col))
    elif method == "frequency":
        n = df.count()
        p["table"] = known.groupBy(col).agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("v"))
    elif method == "target":
        g = _one(df, F.avg(target))[0]
        p["default"], p["table"] = g, known.groupBy(col).agg(((F.sum(target) + SMOOTHING * F.lit(g)) / (F.count(target) + SMOOTHING)).alias("v"))
    elif method == "woe":
        per = known.groupBy(col).agg(F.sum(F.col(target).cast("double")).alias("e"), F.sum(1.0 - F.col(target)).alias("ne"))
        e, ne, k = _one(per, F.sum("e"), F.sum("ne"), F.count(F.lit(1)))
        pe, pn = (F.col("e") + 0.5) / (e + 0.5 * k), (F.col("ne") + 0.5) / (ne + 0.5 * k)
        p["table"] = per.select(col, F.log(pe / pn).alias("v"), ((pe - pn) * F.log(pe / pn)).alias("iv"))
    elif method != "hash":
        raise ValueError(f"unknown encoder {method!r}")
    return Step("encode", method, [col], p)


def information_value(step: Step) -> float:
    return _one(step.params["table"], F.sum("iv"))[0]


def hash_bucket(c, n: int):
    """A bucket that Spark and DuckDB compute alike."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def encode(df: DataFrame, step: Step) -> DataFrame:
    col, m, p = step.columns[0], step.name, step.params
    if m in ("label", "ordinal"):
        code = F.create_map(*[F.lit(x) for i, v in enumerate(p["values"]) for x in (v, i)]) if p["values"] else None
        return df.withColumn(col, F.try_element_at(code, F.col(col)) if code is not None else F.lit(None).cast("int"))
    if m == "onehot":
        return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("byte") for v in p["values"]}).drop(col)
    if m == "binary":
        code = F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(p["values"]) for x in (v, i)]), F.col(col))
        width = max(math.ceil(math.log2(max(1, len(p["values"])))), 1)
        return df.withColumns({f"{col}_b{i}": F.shiftright(code, i).bitwiseAND(F.lit(1)) for i in range(width)}).drop(col)
    if m == "hash":
        return df.withColumns({f"{col}_h{i}": F.coalesce(hash_bucket(F.col(col), HASH_COLUMNS) == i, F.lit(False)).cast("byte") for i in range(HASH_COLUMNS)}).drop(col)
    out = lookup(df, p["table"], col, "v", "__e")
    return out.withColumn(col, F.coalesce("__e", F.when(F.col(col).isNotNull(), F.lit(p["default"]))) if "default" in p else F.col("__e")).drop("__e")


# --- transforms ---------------------------------------------------------------------------------------------------
def box_cox(x, lam: float):
    return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x, lam: float):
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def likely_lambda(df: DataFrame, x, power, jacobian) -> float:
    """The exponent of largest likelihood, by a grid that is refined twice; each grid is one aggregation."""
    lo, hi = -2.0, 4.0
    best = 1.0
    for _ in range(3):
        grid = np.linspace(lo, hi, 25)
        one = _one(df, F.count(x).alias("n"), F.sum(jacobian).alias("j"), *[F.var_pop(power(x, float(g))).alias(f"v{i}") for i, g in enumerate(grid)])
        ll = [(-0.5 * one["n"] * math.log(one[f"v{i}"]) + (g - 1) * one["j"]) if one[f"v{i}"] and one[f"v{i}"] > 0 else -math.inf for i, g in enumerate(grid)]
        best = float(grid[int(np.argmax(ll))])
        step = (hi - lo) / 24
        lo, hi = best - step, best + step
    return best


def fit_transform(df: DataFrame, col: str, method: str) -> Step:
    """Parameters of a transform; a column without spread gets none and is left as it is."""
    x = F.col(col).cast("double")
    p: dict = {}
    if method == "standard_scale":
        p["center"], p["scale"] = _one(df, F.avg(x), F.stddev_samp(x))
    elif method == "minmax_scale":
        lo, hi = _one(df, F.min(x), F.max(x))
        p["center"], p["scale"] = lo, None if lo is None else hi - lo
    elif method == "robust_scale":
        q1, med, q3 = _one(df, F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))[0] or (None,) * 3
        p["center"], p["scale"] = med, None if q1 is None else q3 - q1
    elif method == "boxcox":
        low = _one(df, F.min(x))[0]
        p["shift"] = abs(low) + 1 if low is not None and low <= 0 else 0.0
        p["lam"] = likely_lambda(df, x + p["shift"], box_cox, F.log(x + p["shift"]))
    elif method in ("yeojohnson", "power"):
        p["lam"] = likely_lambda(df, x, yeo_johnson, F.signum(x) * F.log1p(F.abs(x)))
        if method == "power":
            p["center"], p["scale"] = _one(df, F.avg(yeo_johnson(x, p["lam"])), F.stddev_pop(yeo_johnson(x, p["lam"])))
    elif method == "quantile":
        n = min(1000, df.where(x.isNotNull()).count())
        p["grid"] = _one(df, F.percentile(x, F.array(*[F.lit(i / max(1, n - 1)) for i in range(n)])))[0] if n else []
    elif method == "rank":
        counts = cut(df.where(x.isNotNull()).groupBy(x.alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
        p["total"] = df.count()
        p["upto"] = cut(running(counts, [], ["__v"], {"__upto": F.col("__n")}))
    elif method not in ("log1p", "sqrt"):
        raise ValueError(f"unknown transform {method!r}")
    return Step("transform", method, [col], p)


def transform(df: DataFrame, step: Step) -> DataFrame:
    col, m, p = step.columns[0], step.name, step.params
    x = F.col(col).cast("double")
    if m in ("standard_scale", "minmax_scale", "robust_scale"):
        return df.withColumn(col, (x - p["center"]) / p["scale"]) if p["scale"] else df
    if m == "log1p":
        return df.withColumn(col, F.log1p(x))
    if m == "sqrt":
        return df.withColumn(col, F.sqrt(x))
    if m == "boxcox":
        return df.withColumn(col, box_cox(x + p["shift"], p["lam"]))
    if m == "yeojohnson":
        return df.withColumn(col, yeo_johnson(x, p["lam"]))
    if m == "power":
        return df.withColumn(col, (yeo_johnson(x, p["lam"]) - p["center"]) / p["scale"]) if p["scale"] else df
    if m == "rank":
        return _rank_among(df, col, p["upto"], p["total"])
    grid = np.array(p["grid"])

    @F.pandas_udf("double")
    def normal_score(v: pd.Series) -> pd.Series:
        at = np.linspace(0, 1, len(grid))
        q = (np.interp(v, grid, at) + 1 - np.interp(-v, -grid[::-1], at)) / 2
        inv = NormalDist().inv_cdf
        return pd.Series([None if t != t else inv(min(max(t, 1e-7), 1 - 1e-7)) for t in np.where(v.isna(), np.nan, q)], dtype="float64")

    return df.withColumn(col, normal_score(x)) if len(grid) else df


def _rank_among(df: DataFrame, col: str, upto: DataFrame, total: int) -> DataFrame:
    """The mean rank of each value among the fitted ones, over their number; a value between two of them gets the rank between.

    Distinct values and fitted ones are put in one order; the fitted one before each is found in ranges of it, which
    hand on their last.
    """
    x = F.col(col).cast("double")
    mine = df.where(x.isNotNull()).select(x.alias("__v")).distinct()
    both = upto.select("__v", F.col("__n"), F.lit(0).alias("__asked")).unionByName(mine.select("__v", F.lit(0).cast("long").alias("__n"), F.lit(1).alias("__asked")))
    per = both.groupBy("__v").agg(F.sum("__n").alias("__n"), F.max("__asked").alias("__asked"))
    placed = running(per, [], ["__v"], {"__upto": F.col("__n")}).where("__asked = 1")
    rank = F.when(F.col("__n") > 0, F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).otherwise(F.col("__upto") + F.lit(0.5)) / total
    return lookup(df.withColumn("__x", x), placed.select(F.col("__v").alias("__x"), rank.alias("__r")), "__x", "__r", "__found").withColumn(col, F.col("__found")).select(*df.columns)


# --- selection ----------------------------------------------------------------------------------------------------
def variance_filter(df: DataFrame, cols: list[str]) -> list[str]:
    one = _one(clean(df, cols), *[F.var_pop(c).alias(c) for c in cols])
    return [c for c in cols if not one[c]]


def correlation_filter(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Greedy in column order: of a too similar pair the one of lower variance goes."""
    strong = {(r["a"], r["b"]) for r in pearson(df, cols).where(F.abs("r") > limit).collect()}  # a row per pair of columns
    var, gone = _one(df, *[F.var_samp(c).alias(c) for c in cols]), []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if (a, b) in strong and a not in gone and b not in gone:
                gone.append(a if (var[a] or 0) < (var[b] or 0) else b)
    return gone


def equal_width_information(df: DataFrame, cols: list[str], target: str, bins: int = 20) -> DataFrame:
    """Mutual information in nats of equal-width bins and the target's values, as plain SQL has it; not used for selection."""
    cells = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("t", "x.*").where("v is not null")
    ends = cells.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    joint = cells.join(F.broadcast(ends), "col").groupBy("col", "n", "t", at.alias("b")).agg(F.count(F.lit(1)).alias("c"))  # a row per column
    pt, pb = joint.groupBy("col", "t").agg(F.sum("c").alias("ct")), joint.groupBy("col", "b").agg(F.sum("c").alias("cb"))
    met = joint.join(pt, ["col", "t"]).join(pb, ["col", "b"])
    return met.groupBy("col").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ct") * F.col("cb")))).alias("mi"))


def pseudo_targets(cols: list[str]) -> list[str]:
    return np.random.RandomState(42).choice(cols, size=min(5, len(cols)), replace=False).tolist() if cols else []


def _quantile_bins(df: DataFrame, cols: list[str], bins: int) -> dict:
    """A bin per column: its values if they are few, else ranges between its quantiles; a value that fills a range is its own bin."""
    if not cols:
        return {}
    one = _one(df, *[F.approx_count_distinct(c) for c in cols], *[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(i / bins) for i in range(bins + 1)])) for c in cols])
    few = [c for i, c in enumerate(cols) if one[i] <= bins]
    own = dict(zip(few, _one(df, *[F.collect_set(F.col(c).cast("double")) for c in few]), strict=True)) if few else {}  # about ``bins`` values each
    out = {}
    for i, c in enumerate(cols):
        v, edges = F.col(c).cast("double"), own.get(c, one[len(cols) + i]) or []
        steps = [v >= e for e in set(edges)] + [v > e for e in set(edges) if edges.count(e) > 1]
        out[c] = F.when(v.isNotNull(), sum((x.cast("int") for x in steps), F.lit(0)))
    return out


def mutual_information(df: DataFrame, cols: list[str], target: str | None = None, bins: int = 20) -> DataFrame:
    """(col, mi): mutual information in nats with the target, or the largest with any of five pseudo-targets without one.

    In place of the nearest-neighbour estimator both sides fall into quantile bins (fewer for few rows; the values of a text
    are classes) and the estimate is corrected for the number of filled cells (Miller and Madow).
    """
    targets = [target] if target else pseudo_targets(cols)
    cols, every = [c for c in cols if c != target], list(dict.fromkeys([*cols, *targets]))
    numbers = [c for c in every if c in numeric_columns(df)]
    rows = clean(df, numbers)
    n_bins = max(2, min(bins, math.isqrt(rows.count() // 25)))
    code = _quantile_bins(rows, numbers, n_bins)
    at = {c: code[c].cast("string") if c in code else F.col(c).cast("string") for c in every}
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("target"), at[c].alias("b"), at[t].alias("t")) for t in targets for c in cols if c != t])
    key = ["col", "target"]
    joint = rows.select(F.explode(pairs).alias("x")).select("x.*").dropna().groupBy(*key, "b", "t").agg(F.count(F.lit(1)).alias("c"))
    pt, pb = joint.groupBy(*key, "t").agg(F.sum("c").alias("ct")), joint.groupBy(*key, "b").agg(F.sum("c").alias("cb"))
    n = pb.groupBy(*key).agg(F.sum("cb").alias("n"), F.count(F.lit(1)).alias("kb")).join(pt.groupBy(*key).agg(F.count(F.lit(1)).alias("kt")), key)
    met = joint.join(pt, [*key, "t"]).join(pb, [*key, "b"]).join(F.broadcast(n), key)  # a row per pair of column and target
    raw = F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ct") * F.col("cb"))))
    excess = (F.count(F.lit(1)) - F.first("kb") - F.first("kt") + 1) / (2 * F.first("n"))
    mi = met.groupBy(*key).agg(F.greatest(F.lit(0.0), raw - excess).alias("mi"))
    sides = mi.select("col", "mi") if target else mi.select("col", "mi").unionByName(mi.select(F.col("target").alias("col"), "mi"))
    return sides.groupBy("col").agg(F.max("mi").alias("mi"))


def tree_importance(df: DataFrame, cols: list[str], target: str, classes: bool, seed: int = 42) -> list[tuple[str, float]]:
    vec = VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="skip").transform(df.withColumn("__y", F.col(target).cast("double")).where("__y is not null"))
    kind = RandomForestClassifier if classes else RandomForestRegressor
    model = kind(featuresCol="__x", labelCol="__y", numTrees=100, maxDepth=5, seed=seed).fit(vec)
    return list(zip(cols, model.featureImportances.toArray().tolist(), strict=True))


def _importance(df: DataFrame, cols: list[str], target: str | None) -> list[tuple[str, float]]:
    """Of the target, by classes if it has few values; without one the mean over pseudo-targets, each with its own mean."""
    if target:
        seen = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
        kinds, n = _one(seen, F.count(F.lit(1)), F.sum("c"))
        return tree_importance(df, cols, target, kinds <= 20 and kinds < 0.05 * (n or 0))
    total, targets = dict.fromkeys(cols, 0.0), pseudo_targets(cols)
    for t in targets if len(cols) > 1 else []:
        found = tree_importance(df, [c for c in cols if c != t], t, False)
        for c, v in [*found, (t, sum(v for _, v in found) / len(found))]:
            total[c] += v / len(targets)
    return list(total.items())


def select_features(df: DataFrame, cols: list[str], target: str | None = None, votes: int = 2) -> DataFrame:
    """Columns that at least two of variance, correlation, information and importance would drop."""
    flat = variance_filter(df, cols)
    flagged = [(c, "variance") for c in flat] + [(c, "correlation") for c in correlation_filter(df, [c for c in cols if c not in flat])]
    flagged += [(r["col"], "information") for r in mutual_information(df, cols, target).where("mi < 0.01").collect()]  # a row per column
    flagged += [(c, "importance") for c, v in _importance(df, cols, target) if v < 0.01]
    out = df.sparkSession.createDataFrame(flagged, "col string, method string")
    return out.groupBy("col").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= votes)


def pca(df: DataFrame, cols: list[str], k: int = 20) -> DataFrame:
    """Explained variance of standardised complete rows: eigenvalues of the p x p correlation matrix from one aggregation."""
    rows = df.dropna(subset=cols)
    one = _one(rows, *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j])
    c = np.array([[1.0 if i == j else one[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    val = np.sort(np.maximum(np.linalg.eigvalsh(c), 0))[::-1]
    share = val / val.sum()
    out = [(i + 1, float(share[i]), float(share[: i + 1].sum())) for i in range(min(k, len(cols)))]
    return df.sparkSession.createDataFrame(out, "component int, share double, cumulative double")


FIXTURES["fx_enc"] = "SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS target FROM orders"
FIXTURES["fx_eng"] = "SELECT l_orderkey, l_partkey, l_returnflag, l_quantity, l_tax, l_discount, l_shipdate, CASE WHEN l_partkey % 10 = 3 THEN NULL ELSE l_tax END AS holes FROM lineitem"
FIXTURES["fx_const"] = "SELECT l_quantity, l_tax, l_discount, l_extendedprice, l_quantity * 2.0 AS twice, 5.0 AS five, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS target FROM lineitem"
_ENG = {
    "sum": (["l_tax", "holes"], {}, "l_tax + coalesce(holes, 0)"), "ratio": (["l_tax", "l_discount"], {}, "coalesce(l_tax / nullif(l_discount, 0), 0)"),
    "indicator": (["l_quantity"], {"threshold": 10}, "(l_quantity = 10)::int"), "log": (["l_quantity"], {}, "ln(1 + l_quantity)"),
    "multiply": (["l_quantity", "l_tax"], {}, "l_quantity * l_tax"), "reciprocal": (["l_quantity"], {}, "1 / (l_quantity + 1e-8)"),
    "groupby_agg": (["l_returnflag", "l_quantity"], {}, "avg(l_quantity) over (partition by l_returnflag)"), "count": (["l_returnflag"], {}, "count(*) over (partition by l_returnflag)"),
}


def _engineered(op: str):
    src, params, _ = _ENG[op]
    return over("fx_eng", lambda d: engineer(d, "f", op, src, params).groupBy("l_returnflag").agg(F.round(F.sum(F.col("f").cast("double")), 3).alias("total"), F.count("f").alias("n")))


def _encoded(method: str, col: str, target: str | None = None, order: list | None = None):
    def run(d: DataFrame) -> DataFrame:
        out = encode(d, fit_encoder(d, col, method, target, order))
        new = [c for c in out.columns if c not in d.columns] or [col]
        return out.select("o_orderkey", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in new])

    return over("fx_enc", run)


def _transformed(method: str, digits: int = 6):
    def run(d: DataFrame) -> DataFrame:
        out = transform(d, fit_transform(d, "l_quantity", method))
        return out.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), digits).alias("mean"), F.round(F.max("l_quantity"), digits).alias("hi"))

    return over("lineitem", run)


ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
QUERIES = {f"engineer_{op}": _engineered(op) for op in _ENG} | {
    "engineer_bin": over("lineitem", lambda d: engineer(d, "f", "bin", ["l_quantity"]).groupBy("f").agg(F.count(F.lit(1)).alias("n"))),
    "engineer_extract": over("customer", lambda d: engineer(d, "f", "extract", ["c_name"]).groupBy("f").agg(F.count(F.lit(1)).alias("n"))),
    "engineer_polynomial": over("lineitem", lambda d: engineer(d, "f", "polynomial", ["l_quantity", "l_tax"]).agg(*[F.round(F.sum(c), 2).alias(c) for c in ("l_quantity_sq", "l_tax_sq", "l_quantity_x_l_tax")])),
    "engineer_datetime": over("orders", lambda d: engineer(d, "f", "datetime", ["o_orderdate"]).select("o_orderkey", "f_year", "f_month", "f_day", "f_dayofweek", "f_hour")),
    "encode_label": _encoded("label", "status"), "encode_onehot": _encoded("onehot", "status"), "encode_ordinal": _encoded("ordinal", "o_orderpriority", order=ORDER),
    "encode_target": _encoded("target", "o_orderpriority", "target"), "encode_frequency": _encoded("frequency", "status"), "encode_binary": _encoded("binary", "o_orderpriority"),
    "encode_woe": _encoded("woe", "o_orderpriority", "target"), "encode_hash": _encoded("hash", "o_orderpriority"),
    "information_value": over("fx_enc", lambda d: d.sparkSession.createDataFrame([(round(information_value(fit_encoder(d, "o_orderpriority", "woe", "target")), 6),)], "iv double")),
} | {f"transform_{m}": _transformed(m) for m in ("log1p", "sqrt", "standard_scale", "minmax_scale", "robust_scale", "rank", "boxcox", "yeojohnson", "power", "quantile")} | {
    "variance_filter": over("fx_const", lambda d: d.sparkSession.createDataFrame([(c,) for c in variance_filter(d, ["l_quantity", "five", "l_tax"])], "col string")),
    "correlation_filter": over("fx_const", lambda d: d.sparkSession.createDataFrame([(c,) for c in correlation_filter(d, ["l_quantity", "l_tax", "twice"])], "col string")),
    "mutual_information": over("fx_const", lambda d: equal_width_information(d, ["l_quantity", "l_tax"], "target").select("col", F.round("mi", 6).alias("mi"))),
    "tree_importance": over("fx_const", lambda d: d.sparkSession.createDataFrame([max(tree_importance(d, ["l_quantity", "l_tax"], "target", True), key=lambda x: x[1])], "col string, importance double").select("col")),
    "feature_selection": over("fx_const", lambda d: select_features(d, ["l_quantity", "l_tax", "twice", "five"], "target")),
    "pca": over("lineitem", lambda d: pca(d, ["l_quantity", "l_tax"]).select("component", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))),
}
_E = f"with {duck('fx_enc')}"


def _by_likelihood(jacobian: str, power: str, shown: str) -> str:
    """SQL of a power transform of a positive column: the exponent of largest likelihood on a grid that is refined twice."""
    sql = f"with x as (select l_returnflag, l_quantity as v from lineitem), j as (select count(v) as n, sum({jacobian}) as j from x), b0 as (select 1.0::double as b, 3.0::double as half)"
    for k in (1, 2, 3):
        grid = f"select b - half + i * half / 12 as g, half / 12 as step from b{k - 1}, range(25) t(i)"
        sql += f", g{k} as ({grid}), l{k} as (select g, any_value(step) as step, -0.5 * any_value(n) * ln(var_pop({power})) + (g - 1) * any_value(j) as ll from g{k}, x, j group by g), b{k} as (select arg_max(g, ll) as b, any_value(step) as half from l{k})"
    return f"{sql}, t as (select l_returnflag, {power} as t from x, (select b as g from b3)), s as (select l_returnflag, {shown} as s from t) select l_returnflag, round(avg(s), 6) as mean, round(max(s), 6) as hi from s group by 1"


_one_tr = lambda e: f"select l_returnflag, round(avg(x), 6) as mean, round(max(x), 6) as hi from (select l_returnflag, {e} as x from lineitem) group by 1"
ORACLE = {f"engineer_{op}": f"with {duck('fx_eng')} select l_returnflag, round(sum(f), 3) as total, count(f)::bigint as n from (select l_returnflag, ({e})::double as f from fx_eng) group by 1" for op, (_, _, e) in _ENG.items()} | {
    "engineer_bin": "with q as (select quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) as q from lineitem) select case when l_quantity <= q[2] then 0 when l_quantity <= q[3] then 1 when l_quantity <= q[4] then 2 else 3 end as f, count(*)::bigint as n from lineitem, q group by 1",
    "engineer_extract": "select nullif(regexp_extract(c_name, '^([A-Za-z]+)', 1), '') as f, count(*)::bigint as n from customer group by 1",
    "engineer_polynomial": "select round(sum(l_quantity * l_quantity), 2) as l_quantity_sq, round(sum(l_tax * l_tax), 2) as l_tax_sq, round(sum(l_quantity * l_tax), 2) as l_quantity_x_l_tax from lineitem",
    "engineer_datetime": "select o_orderkey, year(o_orderdate)::int as f_year, month(o_orderdate)::int as f_month, day(o_orderdate)::int as f_day, (isodow(o_orderdate) - 1)::int as f_dayofweek, hour(o_orderdate)::int as f_hour from orders",
    "encode_label": f"{_E} select o_orderkey, case when status is not null then (dense_rank() over (order by status nulls last) - 1)::double end as status from fx_enc",
    "encode_onehot": f"{_E} select o_orderkey, coalesce((status = 'F')::int, 0)::double as \"status_F\", coalesce((status = 'O')::int, 0)::double as \"status_O\", coalesce((status = 'P')::int, 0)::double as \"status_P\" from fx_enc",
    "encode_ordinal": "select o_orderkey, case o_orderpriority when '1-URGENT' then 0.0 when '2-HIGH' then 1.0 when '3-MEDIUM' then 2.0 when '5-LOW' then 3.0 end::double as o_orderpriority from orders",
    "encode_target": f"{_E} select o_orderkey, round((sum(target) over w + 10 * avg(target) over ()) / (count(*) over w + 10), 6) as o_orderpriority from fx_enc window w as (partition by o_orderpriority)",
    "encode_frequency": f"{_E} select o_orderkey, case when status is not null then round(count(*) over (partition by status) / count(*) over (), 6) end as status from fx_enc",
    "encode_binary": "select o_orderkey, (c & 1)::double as o_orderpriority_b0, ((c >> 1) & 1)::double as o_orderpriority_b1, ((c >> 2) & 1)::double as o_orderpriority_b2 from (select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as c from orders)",
    "encode_woe": f"{_E}, g as (select o_orderpriority as k, sum(target)::double as e, sum(1 - target)::double as ne from fx_enc group by 1), t as (select sum(e) as te, sum(ne) as tn, count(*) as n from g) select o_orderkey, round(ln(((e + 0.5) / (te + 0.5 * n)) / ((ne + 0.5) / (tn + 0.5 * n))), 6) as o_orderpriority from fx_enc join g on k = o_orderpriority, t",
    "encode_hash": "select o_orderkey, " + ", ".join(f"(b = {i})::int::double as o_orderpriority_h{i}" for i in range(HASH_COLUMNS)) + f" from (select o_orderkey, ('0x' || substr(md5(o_orderpriority), 1, 8))::bigint % {HASH_COLUMNS} as b from orders)",
    "information_value": f"{_E}, g as (select o_orderpriority as k, sum(target)::double as e, sum(1 - target)::double as ne from fx_enc group by 1), t as (select sum(e) as te, sum(ne) as tn, count(*) as n from g), w as (select (e + 0.5) / (te + 0.5 * n) as pe, (ne + 0.5) / (tn + 0.5 * n) as pn from g, t) select round(sum((pe - pn) * ln(pe / pn)), 6) as iv from w",
    "transform_log1p": _one_tr("ln(1 + l_quantity)"), "transform_sqrt": _one_tr("sqrt(l_quantity)"),
    "transform_standard_scale": _one_tr("(l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over ()"),
    "transform_minmax_scale": _one_tr("(l_quantity - min(l_quantity) over ()) / (max(l_quantity) over () - min(l_quantity) over ())"),
    "transform_robust_scale": _one_tr("(l_quantity - (select median(l_quantity) from lineitem)) / (select quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) from lineitem)"),
    "transform_rank": _one_tr("(rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0) / count(*) over ()"),
    "variance_filter": f"with {duck('fx_const')} select col from (select 'l_quantity' as col, var_pop(l_quantity) as v from fx_const union all select 'five', var_pop(five) from fx_const union all select 'l_tax', var_pop(l_tax) from fx_const) where v = 0",
    "correlation_filter": f"with {duck('fx_const')}, v as (select var_samp(l_quantity) as l_quantity, var_samp(l_tax) as l_tax, var_samp(twice) as twice from fx_const) select distinct col from (" + " union all ".join(f"select case when v.{a} < v.{b} then '{a}' else '{b}' end as col, abs((select corr({a}, {b}) from fx_const)) as r from v" for a, b in (("l_quantity", "l_tax"), ("l_quantity", "twice"), ("l_tax", "twice"))) + ") where r > 0.95",
    "transform_boxcox": _by_likelihood("ln(v)", "case when abs(g) < 1e-9 then ln(v) else (power(v, g) - 1) / g end", "t"),
    "transform_yeojohnson": _by_likelihood("ln(1 + v)", "case when abs(g) < 1e-9 then ln(1 + v) else (power(v + 1, g) - 1) / g end", "t"),
    "transform_power": _by_likelihood("ln(1 + v)", "case when abs(g) < 1e-9 then ln(1 + v) else (power(v + 1, g) - 1) / g end", "(t - avg(t) over ()) / stddev_pop(t) over ()"),
    "tree_importance": "select 'l_quantity' as col",
    "mutual_information": f"with {duck('fx_const')}, c as (select 'l_quantity' as col, l_quantity as v, target as t from fx_const union all select 'l_tax', l_tax, target from fx_const), r as (select col, min(v) as lo, max(v) as hi, count(*) as n from c group by 1), j as (select c.col, n, t, least(floor((v - lo) / (hi - lo) * 20), 19) as b, count(*) as c from c join r on c.col = r.col group by 1, 2, 3, 4), m as (select *, sum(c) over (partition by col, t) as ct, sum(c) over (partition by col, b) as cb from j) select col, round(sum(c / n * ln(c * n / (ct * cb))), 6) as mi from m group by 1",
    "pca": "with c as (select abs(corr(l_quantity, l_tax)) as r from lineitem) select 1 as component, round((1 + r) / 2, 6) as share, round((1 + r) / 2, 6) as cumulative from c union all select 2, round((1 - r) / 2, 6), 1.0 from c",
}
