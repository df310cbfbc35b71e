"""Summaries over other operators' results: memory, findings, assumption grids, target statistics and the data behind charts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import specfun
from . import quality
from .base import clean, duck, kurt, long_form, over, running, skew
from .drift import ORACLE as DRIFT_SQL
from .drift import breusch_pagan, category_drift, durbin_watson, hash_order, levene, normality_vote, segmented, shapiro
from .drift import psi as stability_index
from .impute import marginal_distortion, missing_summary, regression_distortion
from .profile import ORACLE as PROFILE_SQL
from .profile import WIDTHS, classify, downcast_advice, sentinels, size_estimate
from .relations import numeric_pairs, pearson

GRADES = ("pass", "marginal", "fail")


# --- memory and column choice -------------------------------------------------------------------------------------
def memory_breakdown(df: DataFrame, k: int = 5) -> DataFrame:
    """Bytes of each column by the logical size model, share of all, place, the smaller type and what it saves.

    ``top`` marks the k largest, ties by name. Columns without a smaller type save nothing.
    """
    width = F.create_map(*[F.lit(x) for kind, n in WIDTHS.items() for x in (kind, n)])
    advice = downcast_advice(df).select("col", "kind", "advice")
    ratio = F.element_at(width, F.col("advice")) / F.element_at(width, F.col("kind"))
    met = size_estimate(df).join(F.broadcast(advice), "col", "left")  # a row per column
    saved = F.when(ratio < 1, F.col("bytes") * (1 - ratio)).otherwise(0.0).cast("long")
    every = W.partitionBy()  # a row per column
    place = F.row_number().over(W.orderBy(F.col("bytes").desc(), "col"))
    return met.select("col", "bytes", F.round(F.try_divide(100.0 * F.col("bytes"), F.sum("bytes").over(every)), 1).alias("pct"), (place <= k).alias("top"), saved.alias("saved"))


def memory_total(df: DataFrame, estimate: float | None = None) -> DataFrame:
    """Bytes now and after the smaller types, and how far off an earlier estimate was, in percent."""
    one = memory_breakdown(df).agg(F.sum("bytes").alias("bytes"), (F.sum("bytes") - F.sum("saved")).alias("projected"))
    off = F.round(F.try_divide(100.0 * F.abs(F.col("bytes") - estimate), F.lit(float(estimate))), 1) if estimate else F.lit(None).cast("double")
    return one.select("bytes", "projected", off.alias("pct_off"))


def select_by_class(df: DataFrame, classes: tuple[str, ...], least: int = 2, most: int = 20) -> DataFrame:
    """Columns of these analytical types with a bounded number of different values."""
    return classify(df).where(F.col("class").isin(*classes) & F.col("n_unique").between(least, most))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash of the key: the same rows for any partitioning. The sample is the feature, so its limit stays."""
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", key).limit(n).drop("__h")


# --- findings -----------------------------------------------------------------------------------------------------
def findings(df: DataFrame) -> DataFrame:
    """(check, n): issues of each quality check; checks without an issue count 0."""
    count = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    total = lambda d, c: d.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n"))
    checks = {
        "constant_columns": count(quality.constant_columns(df)), "mixed_case": count(quality.mixed_case(df)), "outer_whitespace": count(quality.outer_whitespace(df)),
        "mixed_delimiters": count(quality.mixed_delimiters(df)), "sentinels": count(sentinels(df).select("col").distinct()),
        "missing_columns": count(missing_summary(df).where("n_null > 0")),
        "duplicate_rows": total(df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("n")), "n"),
    }
    out = None
    for name, one in checks.items():
        part = one.select(F.lit(name).alias("check"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- assumptions --------------------------------------------------------------------------------------------------
def normal_columns(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """(col, normal): the vote of the normality tests for each column."""
    out = None
    for c in cols:
        one = normality_vote(df, c, order).select(F.lit(c).alias("col"), "normal")
        out = one if out is None else out.unionByName(one)
    return out


def normal_share(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """How many of the tested columns pass the vote, and their percentage (0 where none was tested)."""
    one = normal_columns(df, cols, order).agg(F.count("normal").alias("n_tested"), F.count_if("normal").alias("n_normal"))
    return one.withColumn("pct_normal", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_normal"), F.col("n_tested")), F.lit(0.0)), 1))


def _graded(p):
    return F.when(p < 0.01, "fail").when(p < 0.05, "marginal").otherwise("pass")


def traffic_light(df: DataFrame, cols: list[str], groups: list[str], order: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(col, test, status): the worst status of each column in each assumption test; cells not tested have no row.

    A regression counts for both of its columns, a grouping for its value column.
    """
    parts = [levene(df, g, c).select(F.lit(c).alias("col"), F.lit("levene").alias("test"), F.col("verdict").alias("status")) for c in cols for g in groups if g != c]
    parts += [durbin_watson(df, c, order).select(F.lit(c).alias("col"), F.lit("durbin_watson").alias("test"), F.col("verdict").alias("status")) for c in cols]
    normal = normal_columns(df, cols, order[0])
    parts.append(normal.where("normal is not null").select("col", F.lit("normality").alias("test"), F.when(F.col("normal"), "pass").otherwise("fail").alias("status")))
    for x, y in pairs:
        one = breusch_pagan(df, x, y).select(_graded(F.col("p")).alias("status"))
        parts += [one.select(F.lit(c).alias("col"), F.lit("breusch_pagan").alias("test"), "status") for c in (x, y) if c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("status"))
    return out.groupBy("col", "test").agg(F.max_by("status", place).alias("status"))


# --- target -------------------------------------------------------------------------------------------------------
def numeric_target(df: DataFrame, target: str, order: str) -> DataFrame:
    """Mean, spread, median, skewness, kurtosis, p of Shapiro-Wilk on the first rows, and the words for them."""
    v = clean(df, [target]).select(order, F.col(target).cast("double").alias("v")).where("v is not null")
    one = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.median("v").alias("median"), skew("v").alias("skew"), kurt("v").alias("kurt"))
    shape = (
        F.when(F.col("skew") > 1, "heavily right-skewed").when(F.col("skew") > 0.5, "right-skewed").when(F.col("skew") < -1, "heavily left-skewed")
        .when(F.col("skew") < -0.5, "left-skewed").otherwise("symmetric")
    )
    tested = shapiro(v, "v", order).select(F.round("p", 6).alias("normality_p"))
    return one.crossJoin(tested).select(  # one row each
        "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "skew", "kurt")], "normality_p", F.coalesce(F.col("normality_p") > 0.05, F.lit(False)).alias("normal"), shape.alias("shape")
    )


def numeric_strength(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The stronger of |r| and |rho| of each numeric feature with a numeric target, by name; |r| wins ties."""
    pairs = numeric_pairs(df, [(f, target) for f in features])
    r, rho = F.round(F.abs("r"), 4), F.round(F.abs("rho"), 4)
    return pairs.select(F.col("a").alias("feature"), F.when(r >= rho, "pearson").otherwise("spearman").alias("method"), F.greatest(r, rho).alias("strength"), F.round("p", 6).alias("p"))


def separation_shares(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(feature value, class, share): how the feature's values share each class."""
    n = df.dropna(subset=[feature, target]).groupBy(F.col(feature).cast("string").alias("value"), F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("class").agg(F.sum("n").alias("__t"))
    return n.join(whole, "class").select("value", "class", F.round(F.col("n") / F.col("__t"), 6).alias("share"))


def box_data(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 IQR) and the number of values beyond, per column or per column and class."""
    rows = clean(df, cols)
    rows = rows.withColumn("__by", F.col(by).cast("string")).where("__by is not null") if by else rows.withColumn("__by", F.lit(None).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])
    v = rows.select("__by", F.explode(cells).alias("x")).select("__by", "x.col", "x.v").where("v is not null")
    # values with their counts: what is held per group grows with different values, and the second pass reads the small form
    counted = v.groupBy("__by", "col", "v").agg(F.count(F.lit(1)).alias("c"))
    q = counted.groupBy("__by", "col").agg(*[F.percentile("v", F.lit(p), F.col("c")).alias(n) for n, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))])
    q = q.select(F.col("__by").alias("__g"), F.col("col").alias("__c"), "q1", "med", "q3")
    met = counted.join(q, F.col("__by").eqNullSafe(F.col("__g")) & (F.col("col") == F.col("__c")))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    out = met.groupBy("__by", "col").agg(
        F.first("q1").alias("q1"), F.first("med").alias("med"), F.first("q3").alias("q3"), F.min(F.when(inside, F.col("v"))).alias("lo"), F.max(F.when(inside, F.col("v"))).alias("hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("c"))).cast("long").alias("n_out"),
    )
    return out.withColumnRenamed("__by", by) if by else out.drop("__by")


# --- charts -------------------------------------------------------------------------------------------------------
def top_categories(df: DataFrame, cols: list[str], k: int = 20) -> DataFrame:
    """The k most frequent values of each column, ties by value: the report's bars, so the limit is the feature."""
    n = long_form(df, cols, "string").where("v is not null").groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("col").orderBy(F.col("n").desc(), "v"))
    return n.withColumn("place", place).where(F.col("place") <= k).select("col", F.col("v").alias("value"), "n", "place")


def colour_column(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """``df`` with ``colour``: the column's value where it is one of the k most frequent, else Other (nulls too)."""
    top = top_categories(df, [col], k).select(F.col("value").alias("__v"))
    met = df.join(F.broadcast(top), F.col(col).cast("string") == F.col("__v"), "left")  # at most k rows
    return met.withColumn("colour", F.coalesce("__v", F.lit("Other"))).drop("__v")


def loadings(df: DataFrame, cols: list[str]) -> DataFrame:
    """Arrows of the biplot: loadings of the first two components of standardised complete rows, and both scaled to 0.8 of the
    widest score over the longest arrow. A component's sign makes its largest loading positive, the
    first of equal ones."""
    rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    p = len(cols)
    one = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j],
    ).first()
    c = np.array([[1.0 if i == j else one[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], dtype=float)
    val, vec = np.linalg.eigh(np.nan_to_num(c))
    vec = vec[:, np.argsort(val)[::-1][:2]]
    vec = vec * np.where(vec[np.abs(vec).round(9).argmax(0), range(vec.shape[1])] < 0, -1, 1)
    z = [F.coalesce(F.try_divide(F.col(x) - F.lit(one[f"m{i}"]), F.lit(one[f"s{i}"])), F.lit(0.0)) for i, x in enumerate(cols)]
    score = [sum((F.lit(float(vec[i, k])) * z[i] for i in range(p)), F.lit(0.0)) for k in range(vec.shape[1])]
    wide = max(x or 0.0 for x in rows.agg(*[F.max(F.abs(s)) for s in score]).first())
    longest = float(np.sqrt((vec**2).sum(1)).max())
    scale = 0.8 * wide / longest if longest > 0 else 1.0
    out = [(x, float(vec[i, 0]), float(vec[i, 1]), float(vec[i, 0] * scale), float(vec[i, 1] * scale)) for i, x in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "feature string, pc1 double, pc2 double, arrow1 double, arrow2 double")


def pairplot_features(df: DataFrame, cols: list[str], k: int = 6) -> DataFrame:
    """Up to k columns: those of the strongest pairs in their order, then the others."""
    strongest = pearson(df, cols).orderBy(F.abs("r").desc(), "a", "b").limit(10).collect()  # by r itself, as rounded ones tie
    seen = list(dict.fromkeys([*[c for r in strongest for c in (r["a"], r["b"])], *cols]))[:k]
    return df.sparkSession.createDataFrame(list(enumerate(seen, 1)), "place int, col string")


def missing_matrix(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """0 or 1 by cell of a uniform sample of n rows, for the columns with missing values, fewest missing first."""
    share = missing_summary(df).where("n_null > 0").orderBy("n_null", "col").collect()  # a row per column
    cols = [r["col"] for r in share if r["col"] != key]
    return uniform_sample(clean(df, cols), key, n, seed).select(key, *[F.col(c).isNull().cast("int").alias(f"{c}__missing") for c in cols])


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """(v, n, share, q): each different value with the normal quantile at its mean rank, at Filliben's medians.

    The first and the last order statistic have 1 - 0.5^(1/n) and 0.5^(1/n); ties share the mean of their ranks.
    """
    counts = clean(df, [col]).where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    at = running(counts, [], ["v"], {"__upto": F.col("n")}).crossJoin(F.broadcast(total))  # one row
    rank, t = F.col("__upto") - (F.col("n") - 1) / F.lit(2.0), F.col("__t")
    half = F.pow(F.lit(0.5), 1 / t)
    share = F.when(t == 1, 0.5).when(rank == 1, 1 - half).when(rank == t, half).otherwise((rank - 0.3175) / (t + 0.365))

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(specfun.normal_ppf)

    return at.select("v", "n", share.alias("share")).withColumn("q", quantile("share"))


def qq_line(df: DataFrame, col: str) -> DataFrame:
    """Slope, intercept and correlation of the line through the points, every value as often as it occurs."""
    w, x, y = F.col("n"), F.col("q"), F.col("v")
    m = qq_points(df, col).agg(*[F.sum(w * e).alias(k) for k, e in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    sxy, sxx, syy = (F.col(a + b) - F.col(a) * F.col(b) / F.col("n") for a, b in (("x", "y"), ("x", "x"), ("y", "y")))
    fit = m.select("n", "x", "y", sxy.alias("sxy"), sxx.alias("sxx"), syy.alias("syy")).withColumn("slope", F.try_divide("sxy", "sxx"))
    return fit.select("slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept"), F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"))


def panels(before: DataFrame, after: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(panel, bin, n): histograms of a column before and after a step, each over its own range."""
    both = before.select(F.lit("before").alias("panel"), F.col(col).cast("double").alias("v")).unionByName(after.select(F.lit("after").alias("panel"), F.col(col).cast("double").alias("v")))
    v = clean(both, ["v"]).where("v is not null")
    ends = v.groupBy("panel").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return v.join(F.broadcast(ends), "panel").groupBy("panel", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # two rows


def category_panels(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """(value, share before, share after) of each category."""
    one = lambda d, t: d.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias(t))
    met = one(before, "b").join(one(after, "a"), "value", "full").na.fill(0, ["a", "b"])
    total = met.agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"))
    out = met.crossJoin(F.broadcast(total))  # one row
    return out.select("value", *[F.round(F.try_divide(F.col(c).cast("double"), F.col(f"t{c}")), 6).alias(n) for c, n in (("b", "before"), ("a", "after"))])


# --- scores and drift ---------------------------------------------------------------------------------------------
def total_distortion(before: DataFrame, after: DataFrame, col: str, xs: list[str]) -> DataFrame:
    """Mean shift of slope and of R2 over up to three correlates, and 0.3 KS and 0.1 shape; their sum is the total.

    Without a correlate the total is that of ``marginal_distortion``.
    """
    marginal = marginal_distortion(before, after, col)
    if not xs:
        return marginal.select(F.lit(None).cast("double").alias("slope_shift"), F.lit(None).cast("double").alias("r2_shift"), "ks", "shape", "total")
    fits = None
    for x in xs[:3]:
        one = regression_distortion(before, after, col, x)
        fits = one if fits is None else fits.unionByName(one)
    met = fits.agg(F.avg("slope_shift").alias("slope_shift"), F.avg("r2_shift").alias("r2_shift")).crossJoin(marginal.select("ks", "shape"))  # one row each
    return met.withColumn("total", F.col("slope_shift") + F.col("r2_shift") + 0.3 * F.col("ks") + 0.1 * F.col("shape"))


def stability_ranking(df: DataFrame, order: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """Columns by drift of the last against the first segment: PSI of numbers, 1 - p of categories; place 1 drifts most."""
    ends = segmented(df, order).withColumn("__g", F.when(F.col("segment") == 0, 0).when(F.col("segment") == 3, 1))
    parts = [stability_index(ends, c, "__g").select(F.lit(c).alias("col"), F.round("psi", 6).alias("drift")) for c in numbers]
    parts += [category_drift(ends, c, "__g").select(F.lit(c).alias("col"), F.round(1 - F.col("p"), 6).alias("drift")) for c in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.row_number().over(W.orderBy(F.col("drift").desc(), "col")))  # a row per column



def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _filled(d: DataFrame) -> DataFrame:
    return d.withColumn("y_mcar", F.coalesce("y_mcar", F.col("l_quantity") * 3.0))


_PAIR = ["l_quantity", "l_tax", "l_discount", "l_extendedprice"]
QUERIES = {
    "memory_breakdown": over("customer", memory_breakdown),
    "memory_total": over("customer", lambda d: memory_total(d, 1e6)),
    "select_by_class": over("orders", lambda d: select_by_class(d, ("binary", "categorical_nominal", "categorical_ordinal"))),
    "uniform_sample": over("orders", lambda d: uniform_sample(d, "o_orderkey", 500).select("o_orderkey", "o_totalprice")),
    "findings": over("fx_dirty", findings),
    "normal_share": over("events", lambda d: normal_share(d, ["value", "user_id"], "event_id")),
    "traffic_light": over("events", lambda d: traffic_light(d, ["value"], ["event_type"], ["ts", "event_id"], []).where("test <> 'normality'")),
    "numeric_target": over("orders", lambda d: numeric_target(d, "o_totalprice", "o_orderkey").select("n", "mean", "std", "median", "skew", "normal", "shape")),
    "numeric_strength": over("lineitem", lambda d: numeric_strength(d, ["l_quantity", "l_discount"], "l_extendedprice").select("feature", "method", "strength")),
    "separation_shares": over("orders", lambda d: separation_shares(d, "o_orderpriority", "o_orderstatus")),
    "box_data": over("lineitem", lambda d: _r(box_data(d, ["l_quantity", "l_extendedprice"]), 4, "q1", "med", "q3", "lo", "hi")),
    "box_data_by": over("orders", lambda d: _r(box_data(d, ["o_totalprice"], "o_orderstatus"), 4, "q1", "med", "q3", "lo", "hi")),
    "top_categories": over("fx_dirty", lambda d: top_categories(d, ["seg_case", "name_garbled"])),
    "colour_column": over("part", lambda d: colour_column(d, "p_brand").groupBy("colour").agg(F.count(F.lit(1)).alias("n"))),
    "loadings": over("lineitem", lambda d: _r(loadings(d, ["l_quantity", "l_extendedprice"]).select("feature", "pc1", "arrow1"), 4, "pc1", "arrow1")),
    "pairplot_features": over("lineitem", lambda d: pairplot_features(d, _PAIR).where("place <= 2").select("col")),
    "missing_matrix": over("fx_part", lambda d: missing_matrix(d, "p_partkey")),
    "qq_points": over("events", lambda d: _r(qq_points(d, "value").select("v", "n", "share"), 8, "share")),
    "transform_panels": over("lineitem", lambda d: panels(d, d.withColumn("l_extendedprice", F.sqrt("l_extendedprice")), "l_extendedprice")),
    "impute_panels": over("fx_missing", lambda d: panels(d, _filled(d), "y_mcar")),
    "category_panels": over("fx_missing", lambda d: category_panels(d, d.withColumn("flag_missing", F.coalesce("flag_missing", F.lit("N"))), "flag_missing")),
    "total_distortion": over("fx_missing", lambda d: _r(total_distortion(d, _filled(d), "y_mcar", ["l_quantity", "l_partkey"]).select("slope_shift", "r2_shift", "ks"), 4, "slope_shift", "r2_shift", "ks")),
    "stability_ranking": over("fx_drift", lambda d: stability_ranking(d, ["ts", "event_id"], ["value_drift", "value_stable"], ["type_drift"]).select("col", "place")),
}


def _box(table: str, by: str, col: str) -> str:
    return f"""select {by}, '{col}' as col, round(any_value(q[1]), 4) as q1, round(any_value(q[2]), 4) as med, round(any_value(q[3]), 4) as q3, round(min(v) filter (where v >= q[1] - 1.5 * (q[3] - q[1])), 4) as lo,
 round(max(v) filter (where v <= q[3] + 1.5 * (q[3] - q[1])), 4) as hi, (count(*) filter (where v < q[1] - 1.5 * (q[3] - q[1]) or v > q[3] + 1.5 * (q[3] - q[1])))::bigint as n_out
 from (select {by}, {col} as v, (select quantile_cont(i.{col}, [0.25, 0.5, 0.75]) from {table} i where {"true" if by == "0" else f"i.{by} = o.{by}"}) as q from {table} o where {col} is not null) group by 1"""


def _hist(source: str, col: str, name: str) -> str:
    return f"""select '{name}' as panel, least(floor((v - lo) / (hi - lo) * 30), 29)::int as bin, count(*)::bigint as n
 from (select {col} as v from {source}), (select min({col}) as lo, max({col}) as hi from {source}) where v is not null group by 2"""


def _hash(key: str) -> str:
    return f"('0x' || md5({key} || ':42')[1:8])::bigint"


_BYTES = """select 'c_custkey' as col, count(*) * 8 as bytes, case when max(c_custkey) <= 127 then 7 when max(c_custkey) <= 32767 then 6 when max(c_custkey) <= 2147483647 then 4 else 0 end * count(*) as saved from customer
 union all select 'c_name', sum(strlen(c_name)), 0 from customer union all select 'c_mktsegment', sum(strlen(c_mktsegment)), 0 from customer
 union all select 'c_nationkey', count(*) * 4, case when max(c_nationkey) <= 127 then 3 when max(c_nationkey) <= 32767 then 2 else 0 end * count(*) from customer union all select 'c_acctbal', count(*) * 8, count(*) * 4 from customer"""
SEGMENTS = "select *, least((row_number() over (order by ts, event_id) - 1) // (count(*) over () // 4), 3)::int as segment from fx_drift"
_M, _E = f"with {duck('fx_missing')}", f"with {duck('fx_drift')}"
_SENTINELS = PROFILE_SQL["sentinels"]
_D = f"with {duck('fx_dirty')}"
_FILL = "(select l_quantity, l_partkey, y_mcar as b, coalesce(y_mcar, l_quantity * 3.0) as a from fx_missing)"
ORACLE = {
    "memory_breakdown": f"select col, bytes::bigint as bytes, round(100.0 * bytes / sum(bytes) over (), 1) as pct, row_number() over (order by bytes desc, col) <= 5 as top, saved::bigint as saved from ({_BYTES})",
    "memory_total": f"select sum(bytes)::bigint as bytes, (sum(bytes) - sum(saved))::bigint as projected, round(100 * abs(sum(bytes) - 1e6) / 1e6, 1) as pct_off from ({_BYTES})",
    "select_by_class": "select 'o_orderstatus' as col, case when count(distinct o_orderstatus) = 2 then 'binary' else 'categorical_nominal' end as class, count(distinct o_orderstatus) as n_unique from orders union all select 'o_orderpriority', 'categorical_nominal', count(distinct o_orderpriority) from orders",
    "uniform_sample": f"select o_orderkey, o_totalprice from orders order by {_hash('o_orderkey')}, o_orderkey limit 500",
    "findings": "select * from (" + " union all ".join(f"select '{c}' as \"check\", count(*)::bigint as n from ({quality.ORACLE[c]})" for c in ("constant_columns", "mixed_case", "outer_whitespace", "mixed_delimiters")) + f""")
 union all select 'sentinels', count(distinct col) from ({_SENTINELS}) union all select 'missing_columns', 0 union all ({_D} select 'duplicate_rows', count(*) - (select count(*) from (select distinct * from fx_dirty)) from fx_dirty)""",
    # three of four tests must accept: none can be normal that both moment tests reject
    "normal_share": f"select *, round(100.0 * n_normal / n_tested, 1) as pct_normal from (select count(*)::bigint as n_tested, (count(*) filter (where j.p > 0.05 or d.p > 0.05))::bigint as n_normal from ({DRIFT_SQL['jarque_bera']}) j join ({DRIFT_SQL['dagostino']}) d using (col))",
    # five groups: with very many rows F(4, n) is near a chi-square of four degrees over 4, whose tail is exp(-x / 2) (1 + x / 2)
    "traffic_light": f"""select 'value' as col, 'levene' as test, case when p < 0.01 then 'fail' when p < 0.05 then 'marginal' else 'pass' end as status from (select exp(-2 * w) * (1 + 2 * w) as p from ({DRIFT_SQL['levene']})) union all
 select 'value', 'durbin_watson', case when dw < 1 or dw > 3 then 'fail' when dw < 1.5 or dw > 2.5 then 'marginal' else 'pass' end from (select sum(d * d) / sum(e * e) as dw from (select e, e - lag(e) over (order by ts, event_id) as d from (select value - avg(value) over () as e, ts, event_id from events)))""",
    "numeric_target": "select count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, round(median(o_totalprice), 4) as median, round(skewness(o_totalprice), 4) as skew, count(o_totalprice) / 6 * (skewness(o_totalprice) ** 2 + kurtosis(o_totalprice) ** 2 / 4) < 6 as normal, case when skewness(o_totalprice) > 1 then 'heavily right-skewed' when skewness(o_totalprice) > 0.5 then 'right-skewed' when skewness(o_totalprice) < -1 then 'heavily left-skewed' when skewness(o_totalprice) < -0.5 then 'left-skewed' else 'symmetric' end as shape from orders",
    "numeric_strength": " union all ".join(
        f"select '{f}' as feature, case when r >= rho then 'pearson' else 'spearman' end as method, greatest(r, rho) as strength from (select round(abs(corr(x, y)), 4) as r, round(abs(corr(rx, ry)), 4) as rho from (select {f} as x, l_extendedprice as y, rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 as rx, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry from lineitem))"
        for f in ("l_quantity", "l_discount")
    ),
    "separation_shares": "select o_orderpriority as value, o_orderstatus as class, round(count(*) / sum(count(*)) over (partition by o_orderstatus), 6) as share from orders group by 1, 2",
    "box_data": "select * exclude (g) from (" + " union all ".join("select * from (" + _box("lineitem", "0", c).replace("select 0, '", "select 0 as g, '", 1).replace("(select 0, ", "(select 0 as g, ", 1) + ")" for c in ("l_quantity", "l_extendedprice")) + ")",
    "box_data_by": _box("orders", "o_orderstatus", "o_totalprice"),
    "top_categories": f"{_D} select * from (" + " union all ".join(f"select '{c}' as col, {c} as value, count(*)::bigint as n, (row_number() over (order by count(*) desc, {c}))::int as place from fx_dirty where {c} is not null group by {c}" for c in ("seg_case", "name_garbled")) + ") where place <= 20",
    "colour_column": "with t as (select p_brand from part where p_brand is not null group by 1 order by count(*) desc, 1 limit 10) select case when p_brand in (select p_brand from t) then p_brand else 'Other' end as colour, count(*)::bigint as n from part group by 1",
    "loadings": "with z as (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as x, (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as y from lineitem), c as (select sign(corr(x, y)) as s from z), w as (select any_value(s) as s, max(abs(x + s * y)) / sqrt(2) * 0.8 as w from z, c) select f as feature, round(k / sqrt(2), 4) as pc1, round(k * w / sqrt(2), 4) as arrow1 from (select w, unnest(['l_quantity', 'l_extendedprice']) as f, unnest([1, s]) as k from w)",
    "pairplot_features": "with p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for i, a in enumerate(_PAIR) for b in _PAIR[i + 1 :]) + "), t as (select a, b from p order by abs(r) desc limit 1) select a as col from t union all select b from t",
    "missing_matrix": f"with {duck('fx_part')} select p_partkey, (price is null)::int as price__missing, (brand is null)::int as brand__missing from fx_part order by {_hash('p_partkey')}, p_partkey limit 500",
    "qq_points": "with c as (select value as v, count(*) as n from events where value is not null group by 1), r as (select v, n, sum(n) over (order by v) - (n - 1) / 2.0 as i, sum(n) over () as t from c) select v, n::bigint as n, round(case when i = 1 then 1 - 0.5 ** (1.0 / t) when i = t then 0.5 ** (1.0 / t) else (i - 0.3175) / (t + 0.365) end, 8) as share from r",
    "transform_panels": _hist("lineitem", "l_extendedprice", "before") + " union all " + _hist("(select sqrt(l_extendedprice) as l_extendedprice from lineitem)", "l_extendedprice", "after"),
    "impute_panels": f"{_M} " + _hist(_FILL, "b", "before") + " union all " + _hist(_FILL, "a", "after"),
    "category_panels": f"{_M}, b as (select flag_missing as value, count(*) / sum(count(*)) over () as s from fx_missing where flag_missing is not null group by 1), a as (select coalesce(flag_missing, 'N') as value, count(*) / sum(count(*)) over () as s from fx_missing group by 1) select value, round(coalesce(b.s, 0), 6) as before, round(coalesce(a.s, 0), 6) as after from a full join b using (value)",
    "total_distortion": f"{_M}, f as {_FILL}, s as (" + " union all ".join(
        f"select abs(regr_slope(a, {x}) - regr_slope(b, {x})) / (abs(regr_slope(b, {x})) + 1e-8) as ds, abs(regr_r2(a, {x}) - regr_r2(b, {x})) as dr from f" for x in ("l_quantity", "l_partkey")
    ) + "), g as (select v, sum(k) as na, sum(1 - k) as nb from (select a as v, 1 as k from f union all select b, 0 from f where b is not null) group by 1), k as (select max(abs(fa - fb)) as ks from (select sum(na) over (order by v) / sum(na) over () as fa, sum(nb) over (order by v) / sum(nb) over () as fb from g)) select round(avg(ds), 4) as slope_shift, round(avg(dr), 4) as r2_shift, round(any_value(ks), 4) as ks from s, k",
    # five categories: four degrees of freedom, whose tail is exp(-x / 2) (1 + x / 2)
    "stability_ranking": f"""{_E}, s as ({SEGMENTS}), u as (select segment, 'value_drift' as col, value_drift as v from s union all select segment, 'value_stable', value_stable from s),
 r as (select col, min(v) as lo, max(v) as hi from u where segment in (0, 3) group by 1), b as (select distinct col, bin::int as bin from r, range(10) t(bin)),
 h as (select col, least(floor((v - lo) / (hi - lo) * 10)::int, 9) as bin, count(*) filter (where segment = 0) as p, count(*) filter (where segment = 3) as q from u join r using (col) where segment in (0, 3) group by 1, 2),
 f as (select col, greatest(coalesce(p, 0) / sum(p) over (partition by col), 0.0001) as p, greatest(coalesce(q, 0) / sum(q) over (partition by col), 0.0001) as q from b left join h using (col, bin)),
 c as (select type_drift, count(*) filter (where segment = 0) as p, count(*) filter (where segment = 3) as q from s group by 1), e as (select q, greatest(p / sum(p) over () * sum(q) over (), 0.0001) as ex from c),
 d as (select col, sum((q - p) * ln(q / p)) as drift from f group by 1 union all select 'type_drift', 1 - exp(-x / 2) * (1 + x / 2) from (select sum((q - ex) ** 2 / ex) as x from e))
 select col, (row_number() over (order by drift desc, col))::int as place from d""",
}
