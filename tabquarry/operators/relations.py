"""Correlations, VIF, association tests, target analysis, leakage checks, interactions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import specfun
from .base import clean, duck, long_form, numeric_columns, over, rank_table, ratio, string_columns
from .profile import TARGET_NAMES, column_profile

LEAK_WORDS = ("future", "next", "predicted", "forecast")


def _real(x) -> float | None:
    return None if x is None or x != x else float(x)


# --- correlations -------------------------------------------------------------------------------------------------
def _r(a: str, b: str):
    """Pearson correlation on rows complete in both; null for constants."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(df: DataFrame, cols: list[str], chunk: int = 400) -> DataFrame:
    """(a, b, r) of all pairs; every ``chunk`` pairs are one aggregation, so that generated code stays small."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    out = None
    for k in range(0, len(pairs), chunk):
        part = pairs[k : k + chunk]
        one = clean(df, cols).agg(*[_r(a, b).alias(f"p{i}") for i, (a, b) in enumerate(part)])
        cells = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(part)])).alias("x")).select("x.*")
        out = cells if out is None else out.unionByName(cells)
    return out.where("r is not null")


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson on average ranks of the rows complete in both."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a), F.col(b))
    ranks = rows.join(rank_table(rows, a, "__ra"), a).join(rank_table(rows, b, "__rb"), b)  # each table from the rows, not from the join before
    return ranks.agg(_r("__ra", "__rb").alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, rho) of all pairs. Columns without nulls are ranked once each, and one aggregation has all their pairs; a pair with
    a column that has nulls is ranked on its own complete rows."""
    d = clean(df, cols).select(*cols)
    holes = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    whole = [c for c in cols if not holes[c]]
    out = None
    if len(whole) > 1:
        ranks = d.select(*whole)
        for i, c in enumerate(whole):
            ranks = ranks.join(rank_table(d, c, f"__r{i}"), c)
        names = F.array(*[F.lit(c) for c in whole])
        at = lambda c: F.element_at(names, F.substring(c, 4, 9).cast("int") + 1)
        out = pearson(ranks.select(*[f"__r{i}" for i in range(len(whole))]), [f"__r{i}" for i in range(len(whole))]).select(at("a").alias("a"), at("b").alias("b"), F.col("r").alias("rho"))
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if a not in whole or b not in whole:
                one = spearman_pair(d, a, b)
                out = one if out is None else out.unionByName(one)
    return out.where("rho is not null")


def top_pairs(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """The k strongest pairs with their grade."""
    grade = F.when(F.abs("r") > 0.9, "very_strong").when(F.abs("r") > 0.7, "strong").otherwise("weak")
    return pearson(df, cols).withColumn("r", F.round("r", 4)).orderBy(F.abs("r").desc(), "a", "b").limit(k).withColumn("grade", grade)


def rank_divergence(df: DataFrame, cols: list[str]) -> DataFrame:
    return pearson(df, cols).join(spearman(df, cols), ["a", "b"]).select("a", "b", F.round(F.abs(F.col("r") - F.col("rho")), 4).alias("gap"))


def vif(df: DataFrame, cols: list[str], centered: bool = False) -> DataFrame:
    """Variance inflation from the Gram matrix of complete rows: one aggregation, a p x p inverse on the driver."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(*[F.col(c).cast("double").alias(c) for c in cols])
    moment = (lambda x, y: F.covar_pop(x, y)) if centered else (lambda x, y: F.avg(F.col(x) * F.col(y)))
    one = rows.agg(*[moment(a, b).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    g = np.array([[float(one[f"g{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(len(cols))] for i in range(len(cols))])
    scale = np.sqrt(np.diag(g)) + (np.diag(g) == 0)
    inv = np.linalg.pinv(g / np.outer(scale, scale))
    out = [(c, float(v), "severe" if v > 10 else "moderate" if v > 5 else "ok") for c, v in zip(cols, np.diag(inv), strict=True) if np.isfinite(v)]
    return df.sparkSession.createDataFrame(out, "col string, vif double, grade string")


# --- association tests --------------------------------------------------------------------------------------------
def with_p(df: DataFrame, p_of, name: str = "p") -> DataFrame:
    """A p-value per row of a small result (a row per pair of columns); computed where the rows are."""
    return df.withColumn(name, F.udf(lambda r: p_of(r.asDict()), T.DoubleType())(F.struct(*df.columns)))


def numeric_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """r, its two-sided p and rho of each pair with at least five complete rows."""
    out = None
    for a, b in pairs:
        rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        one = rows.agg(F.count(F.lit(1)).alias("n"), _r(a, b).alias("r")).crossJoin(spearman_pair(df, a, b))  # one row each
        out = one if out is None else out.unionByName(one)
    tested = with_p(out.where("n >= 5 and r is not null"), lambda x: 0.0 if abs(x["r"]) >= 1 else specfun.t_sf2(x["r"] * ((x["n"] - 2) / (1 - x["r"] ** 2)) ** 0.5, x["n"] - 2))
    return tested.select("a", "b", "n", "r", "rho", "p")


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("s2"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F, p and eta squared over the groups of at least two values."""
    g = group_stats(df, group, value).where("n >= 2")
    t = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("n").alias("big_n"), F.count(F.lit(1)).alias("k"))
    s = g.crossJoin(F.broadcast(t)).agg(  # one row
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("ssb"), F.sum((F.col("n") - 1) * F.col("s2")).alias("ssw"), F.max("big_n").alias("big_n"), F.max("k").alias("k")
    )
    out = s.where("k >= 2").select(
        F.lit(group).alias("group_col"), F.lit(value).alias("value_col"), F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("big_n") - F.col("k"))).alias("f"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_sq"), "k", "big_n",
    )
    return with_p(out, lambda x: None if x["f"] is None else specfun.f_sf(x["f"], x["k"] - 1, x["big_n"] - x["k"]))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (with Yates' correction for one degree of freedom), p and Cramer's V. Empty cells are added up in closed form."""
    o = crosstab(df, a, b)
    ra, rb = o.groupBy("a").agg(F.sum("n").alias("ta")), o.groupBy("b").agg(F.sum("n").alias("tb"))
    dims = ra.agg(F.count(F.lit(1)).alias("r"), F.sum("ta").alias("t")).crossJoin(rb.agg(F.count(F.lit(1)).alias("c")))  # one row each
    cells = ra.crossJoin(rb).join(o, ["a", "b"], "left").crossJoin(F.broadcast(dims))  # categories x categories, as a contingency table is
    ex = F.col("ta") * F.col("tb") / F.col("t")
    d = F.coalesce("n", F.lit(0)) - ex
    yates = F.abs(d) - F.least(F.lit(0.5), F.abs(d))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    term = F.when(dof == 1, yates * yates).otherwise(d * d) / ex
    s = cells.withColumn("term", term).agg(F.sum("term").alias("chi2"), F.max("t").alias("t"), F.max("r").alias("r"), F.max("c").alias("c"))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("t") * (F.least("r", "c") - 1)))
    out = s.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), v.alias("v"))
    return with_p(out, lambda x: None if not x["dof"] else specfun.chi2_sf(x["chi2"], x["dof"]))


# --- target analysis ----------------------------------------------------------------------------------------------
def target_type(df: DataFrame, target: str) -> DataFrame:
    u = F.col("n_unique")
    textual = not isinstance(df.schema[target].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType))
    kind = F.when(u <= 2, "binary").when((u <= 20) & (F.lit(textual) | (u <= 10)), "categorical").otherwise("numeric")
    return column_profile(df, [target]).select("col", kind.alias("type"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    c = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    one = c.agg(F.count(F.lit(1)).alias("classes"), (F.min("n") / F.max("n")).alias("balance"), (100.0 * F.min("n") / F.sum("n")).alias("minority"))
    return one.select("classes", F.round("balance", 4).alias("balance"), F.round("minority", 2).alias("minority"), (F.col("minority") < 20).alias("imbalanced"))


def point_biserial(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    one = clean(df).agg(*[_r(c, target).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.abs(c), 4).alias("strength")) for c in cols])).alias("x")).select("x.*")


def category_code_rho(df: DataFrame, cat: str, target: str) -> DataFrame:
    """Spearman correlation of the order of the categories with a numeric target."""
    codes = df.where(F.col(cat).isNotNull()).select(cat).distinct().select(cat, (F.row_number().over(W.orderBy(cat)) - 1).alias("__code"))  # a row per category
    return spearman_pair(df.join(codes, cat), "__code", target).select(F.lit(cat).alias("feature"), F.round(F.abs("rho"), 4).alias("strength"))


def feature_ranking(df: DataFrame, numbers: list[str], texts: list[str], target: str) -> DataFrame:
    """Strength of each feature towards a class target: point-biserial for numbers, Cramer's V for categories."""
    out = point_biserial(df, numbers, target)
    for c in texts:
        out = out.unionByName(chi_square(df, c, target).select(F.lit(c).alias("feature"), F.round("v", 4).alias("strength")))
    return out.where("strength is not null").withColumn("rank", F.row_number().over(W.orderBy(F.desc("strength"), "feature")))  # a row per feature


def class_divergence(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Features whose class means range over more than half their standard deviation."""
    cells = df.where(F.col(target).isNotNull()).select(target, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(target, "x.*")
    means = cells.groupBy("col", target).agg(F.avg("v").alias("m")).groupBy("col").agg((F.max("m") - F.min("m")).alias("span"))
    std = cells.groupBy("col").agg(F.stddev_samp("v").alias("s"))
    return means.join(std, "col").where("span > 0.5 * s").select("col", F.round("span", 4).alias("span"), F.round("s", 4).alias("std"))


# --- leakage ------------------------------------------------------------------------------------------------------
def target_correlation_leaks(df: DataFrame, cols: list[str], target: str, limit: float = 0.95) -> DataFrame:
    return point_biserial(df, cols, target).where(F.col("strength") > limit)


def bijections(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Columns in one-to-one relation with the target on at least ten rows."""
    out = None
    for c in cols:
        pairs = crosstab(df, c, target)
        forward, back = (pairs.groupBy(x).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias(f"k_{x}")) for x in ("a", "b"))
        one = pairs.agg(F.sum("n").alias("n")).crossJoin(forward).crossJoin(back)  # one row each
        one = one.select(F.lit(c).alias("col"), ((F.col("n") >= 10) & (F.col("k_a") == 1) & (F.col("k_b") == 1)).alias("bijection"))
        out = one if out is None else out.unionByName(one)
    return out.where("bijection")


def temporal_words(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in df.columns if any(w in c.lower() for w in LEAK_WORDS)], "col string")


def future_dates(df: DataFrame, first: str, others: list[str], limit: float = 0.9) -> DataFrame:
    """Dates that come after the first date column in more than 90% of the rows (at least ten)."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), (F.col(c) > F.col(first)).cast("double").alias("later")) for c in others])).alias("x")).select("x.*")
    return cells.groupBy("col").agg(F.count("later").alias("n"), F.round(F.avg("later"), 4).alias("share")).where((F.col("n") >= 10) & (F.col("share") > limit))


def high_cardinality_text(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return column_profile(df, string_columns(df)).where(F.col("n_unique") / (F.col("n") - F.col("n_null")) > limit).select("col", "n_unique")


def near_constant(df: DataFrame, cols: list[str], target: str, share: float = 0.01) -> DataFrame:
    """Columns that hardly vary inside any class of the target."""
    cells = df.where(F.col(target).isNotNull()).select(target, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(target, "x.*")
    inside = cells.groupBy("col", target).agg(F.stddev_samp("v").alias("s")).groupBy("col").agg(F.max("s").alias("most"))
    return inside.join(cells.groupBy("col").agg(F.stddev_samp("v").alias("all")), "col").where(F.col("most") < share * F.col("all")).select("col")


def identifiers_present(df: DataFrame) -> DataFrame:
    share = F.col("n_unique") / (F.col("n") - F.col("n_null"))
    return column_profile(df).where((share == 1) & (F.col("n_unique") > 1)).select("col")


def find_target(df: DataFrame) -> DataFrame:
    """The column that a rule takes for the target: a known name with two values, else a known name."""
    per = column_profile(df, [c for c in df.columns if c.lower() in TARGET_NAMES])
    return per.orderBy((F.col("n_unique") != 2), "col").limit(1).select("col", "n_unique")


# --- interactions -------------------------------------------------------------------------------------------------
def interaction_means(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    return df.dropna(subset=[a, b, target]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 4).alias("mean"))


def interaction_score(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """Mean over the levels of b of the spread of a's means, over the spread of a's overall means."""
    rows = df.dropna(subset=[a, b, target])
    overall = rows.groupBy(a).agg(F.avg(target).alias("m")).agg(F.stddev_samp("m").alias("all"))
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"))
    levels = cells.groupBy(b).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.stddev_samp("m").alias("s")).where("n >= 5 and k >= 2")
    inner = levels.agg(F.avg("s").alias("inner"), F.count(F.lit(1)).alias("levels"))
    return inner.crossJoin(overall).where("levels >= 2").select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.try_divide("inner", "all"), 4).alias("score"))  # one row each


def top_interactions(df: DataFrame, cats: list[str], target: str, k: int = 5) -> DataFrame:
    out = None
    for i, a in enumerate(cats):
        for b in cats[i + 1 :]:
            one = interaction_score(df, a, b, target)
            out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), "a", "b").limit(k)


def important_categoricals(df: DataFrame, cats: list[str], numbers: list[str], k: int = 5) -> DataFrame:
    out = None
    for c in cats:
        for x in numbers:
            one = anova(df, c, x).select(F.lit(c).alias("col"), "eta_sq")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("col").agg(F.round(F.max("eta_sq"), 6).alias("eta_sq")).orderBy(F.desc("eta_sq"), "col").limit(k)


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
r4 = lambda d, *cols, n=4: d.withColumns({c: F.round(c, n) for c in cols})
_pairs = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]
_rho = lambda a, b, t: f"(select corr(ra, rb) from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb from {t}))"
QUERIES = {
    "pearson": over("lineitem", lambda d: r4(pearson(d, NUM), "r")),
    "spearman": over("lineitem", lambda d: r4(spearman(d, NUM), "rho")),
    "top_pairs": over("fx_derived", lambda d: top_pairs(d, ["l_quantity", "l_tax", "l_discount", "l_extendedprice", "d_sum", "d_prod"], 5)),
    "rank_divergence": over("lineitem", lambda d: rank_divergence(d, ["l_quantity", "l_extendedprice"])),
    "vif": over("lineitem", lambda d: r4(vif(d, ["l_quantity", "l_tax"]), "vif")),
    "vif_centered": over("lineitem", lambda d: r4(vif(d, ["l_quantity", "l_tax"], centered=True), "vif")),
    "numeric_pairs": over("lineitem", lambda d: r4(numeric_pairs(d, [("l_quantity", "l_extendedprice")]), "r", "rho").drop("p")),
    "anova": over("events", lambda d: r4(r4(anova(d, "event_type", "value").drop("p"), "f"), "eta_sq", n=6)),
    "crosstab": over("orders", lambda d: crosstab(d, "o_orderpriority", "o_orderstatus")),
    "chi_square": over("orders", lambda d: r4(chi_square(d, "o_orderpriority", "o_orderstatus").drop("p"), "chi2", "v")),
    "chi_square_yates": over("fx_target", lambda d: r4(chi_square(d.withColumn("late", F.col("o_orderkey") % 2), "late", "target").drop("p"), "chi2", "v")),
    "target_type": over("fx_target", lambda d: target_type(d, "target")),
    "class_balance": over("fx_target", lambda d: class_balance(d, "target")),
    "point_biserial": over("fx_target", lambda d: point_biserial(d, ["o_totalprice", "o_custkey", "leak_near_const"], "target")),
    "category_code_rho": over("orders", lambda d: category_code_rho(d, "o_orderpriority", "o_totalprice")),
    "feature_ranking": over("fx_target", lambda d: feature_ranking(d, ["o_totalprice", "o_custkey"], ["o_orderpriority", "o_orderstatus"], "target")),
    "class_divergence": over("fx_target", lambda d: class_divergence(d, ["o_totalprice", "o_custkey", "leak_near_const"], "target")),
    "leak_correlation": over("fx_target", lambda d: target_correlation_leaks(d, ["o_totalprice", "leak_near_const"], "target")),
    "leak_bijection": over("fx_target", lambda d: bijections(d, ["leak_bijection", "o_orderstatus", "o_orderpriority"], "target").select("col")),
    "leak_temporal_words": over("fx_target", temporal_words),
    "leak_future_dates": over("fx_target", lambda d: future_dates(d, "o_orderdate", ["ship_date", "end_date"])),
    "leak_high_cardinality": over("fx_dirty", high_cardinality_text),
    "leak_near_constant": over("fx_target", lambda d: near_constant(d, ["leak_near_const", "o_totalprice"], "target")),
    "leak_identifiers": over("customer", identifiers_present),
    "find_target": over("fx_target", find_target),
    "interaction_means": over("lineitem", lambda d: interaction_means(d, "l_returnflag", "l_linestatus", "l_quantity")),
    "interaction_score": over("lineitem", lambda d: interaction_score(d, "l_returnflag", "l_linestatus", "l_quantity")),
    "top_interactions": over("lineitem", lambda d: top_interactions(d, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")),
    "important_categoricals": over("fx_target", lambda d: important_categoricals(d, ["o_orderpriority", "o_orderstatus", "leak_bijection"], ["o_totalprice"])),
}
_an = lambda g, v, t: f"""(with g as (select {g} as k, count({v}) as n, avg({v}) as m, var_samp({v}) as s2 from {t} where {g} is not null group by 1 having count({v}) >= 2),
 t as (select sum(n * m) / sum(n) as gm, sum(n) as big_n, count(*) as k from g), s as (select sum(n * (m - gm) ** 2) as ssb, sum((n - 1) * s2) as ssw, max(t.big_n) as big_n, max(t.k) as k from g, t)
 select ssb / (k - 1) / (ssw / (big_n - k)) as f, ssb / (ssb + ssw) as eta_sq, k, big_n from s)"""  # noqa: E731
_chi = lambda a, b, t, yates=False: f"""(with o as (select {a}::varchar as a, {b}::varchar as b, count(*)::double as n from {t} group by 1, 2), ra as (select a, sum(n) as ta from o group by a), rb as (select b, sum(n) as tb from o group by b), tt as (select sum(n) as t from o),
 e as (select ra.a, rb.b, coalesce(o.n, 0) as n, ta * tb / t as ex, t from ra cross join rb cross join tt left join o on o.a = ra.a and o.b = rb.b)
 select sum({'(abs(n - ex) - least(0.5, abs(n - ex)))' if yates else '(n - ex)'} ** 2 / ex) as chi2, ((count(distinct a) - 1) * (count(distinct b) - 1))::bigint as dof, max(t) as t, least(count(distinct a), count(distinct b)) - 1 as q from e)"""  # noqa: E731
_score = lambda a, b: f"""(select round(avg(s) / max(o.al), 4) from (select {b}, sum(n) as n, count(*) as k, stddev_samp(m) as s from (select {a}, {b}, count(*) as n, avg(l_quantity) as m from lineitem group by 1, 2) group by 1) l,
 (select stddev_samp(m) as al from (select avg(l_quantity) as m from lineitem group by {a})) o where n >= 5 and k >= 2)"""  # noqa: E731
_T = f"with {duck('fx_target')}"
ORACLE = {
    "pearson": " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from lineitem" for a, b in _pairs),
    "spearman": " union all ".join(f"select '{a}' as a, '{b}' as b, round({_rho(a, b, 'lineitem')}, 4) as rho" for a, b in _pairs),
    "top_pairs": f"with {duck('fx_derived')}, p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from fx_derived" for i, a in enumerate(["l_quantity", "l_tax", "l_discount", "l_extendedprice", "d_sum", "d_prod"]) for b in ["l_quantity", "l_tax", "l_discount", "l_extendedprice", "d_sum", "d_prod"][i + 1 :]) + ") select *, case when abs(r) > 0.9 then 'very_strong' when abs(r) > 0.7 then 'strong' else 'weak' end as grade from p order by abs(r) desc, a, b limit 5",
    "rank_divergence": f"select 'l_quantity' as a, 'l_extendedprice' as b, round(abs((select corr(l_quantity, l_extendedprice) from lineitem) - {_rho('l_quantity', 'l_extendedprice', 'lineitem')}), 4) as gap",
    "vif": "with g as (select sum(l_quantity * l_quantity) as a, sum(l_tax * l_tax) as b, sum(l_quantity * l_tax) as c from lineitem), v as (select round(1 / (1 - c * c / (a * b)), 4) as vif from g) select col, vif, case when vif > 10 then 'severe' when vif > 5 then 'moderate' else 'ok' end as grade from v, (values ('l_quantity'), ('l_tax')) t(col)",
    "vif_centered": "with v as (select round(1 / (1 - corr(l_quantity, l_tax) ** 2), 4) as vif from lineitem) select col, vif, 'ok' as grade from v, (values ('l_quantity'), ('l_tax')) t(col)",
    "numeric_pairs": f"select 'l_quantity' as a, 'l_extendedprice' as b, count(*)::bigint as n, round(corr(l_quantity, l_extendedprice), 4) as r, round({_rho('l_quantity', 'l_extendedprice', 'lineitem')}, 4) as rho from lineitem",
    "anova": f"select 'event_type' as group_col, 'value' as value_col, round(f, 4) as f, round(eta_sq, 6) as eta_sq, k::bigint as k, big_n::bigint as big_n from {_an('event_type', 'value', 'events')}",
    "crosstab": "select o_orderpriority as a, o_orderstatus as b, count(*)::bigint as n from orders group by 1, 2",
    "chi_square": f"select 'o_orderpriority' as col_a, 'o_orderstatus' as col_b, round(chi2, 4) as chi2, dof, round(sqrt(chi2 / (t * q)), 4) as v from {_chi('o_orderpriority', 'o_orderstatus', 'orders')}",
    "chi_square_yates": f"{_T}, x as (select *, o_orderkey % 2 as late from fx_target) select 'late' as col_a, 'target' as col_b, round(chi2, 4) as chi2, dof, round(sqrt(chi2 / (t * q)), 4) as v from {_chi('late', 'target', 'x', True)}",
    "target_type": f"{_T} select 'target' as col, case when k <= 2 then 'binary' when k <= 10 then 'categorical' else 'numeric' end as type from (select count(distinct target) as k from fx_target)",
    "class_balance": f"{_T}, c as (select count(*) as n from fx_target group by target) select count(*)::bigint as classes, round(min(n) / max(n), 4) as balance, round(100.0 * min(n) / sum(n), 2) as minority, 100.0 * min(n) / sum(n) < 20 as imbalanced from c",
    "point_biserial": _T + " " + " union all ".join(f"select '{c}' as feature, round(abs(corr({c}, target)), 4) as strength from fx_target" for c in ["o_totalprice", "o_custkey", "leak_near_const"]),
    "category_code_rho": f"select 'o_orderpriority' as feature, round(abs({_rho('o_orderpriority', 'o_totalprice', 'orders')}), 4) as strength",
    "feature_ranking": f"{_T}, s as (" + " union all ".join(f"select '{c}' as feature, round(abs(corr({c}, target)), 4) as strength from fx_target" for c in ["o_totalprice", "o_custkey"]) + " union all " + " union all ".join(f"select '{c}' as feature, round(sqrt(chi2 / (t * q)), 4) as strength from {_chi(c, 'target', 'fx_target')}" for c in ["o_orderpriority", "o_orderstatus"]) + ") select feature, strength, row_number() over (order by strength desc, feature)::int as rank from s",
    "class_divergence": _T + " select * from (" + " union all ".join(f"select '{c}' as col, round(max(m) - min(m), 4) as span, round((select stddev_samp({c}) from fx_target), 4) as std from (select avg({c}) as m from fx_target group by target)" for c in ["o_totalprice", "o_custkey", "leak_near_const"]) + ") where span > 0.5 * std",
    "leak_correlation": f"{_T} select 'leak_near_const' as feature, round(abs(corr(leak_near_const, target)), 4) as strength from fx_target",
    "leak_bijection": _T + " select col from (" + " union all ".join(f"select '{c}' as col, (select max(k) from (select count(distinct target) as k from fx_target group by {c})) as f, (select max(k) from (select count(distinct {c}) as k from fx_target group by target)) as b, count(*) as n from fx_target" for c in ["leak_bijection", "o_orderstatus", "o_orderpriority"]) + ") where f = 1 and b = 1 and n >= 10",
    "leak_temporal_words": f"{_T}, w as (select unnest(map_keys(to_json(t)::json::map(varchar, varchar))) as col from (select * from fx_target limit 1) t) select col from w where regexp_matches(lower(col), '{'|'.join(LEAK_WORDS)}')",
    "leak_future_dates": f"{_T} select 'ship_date' as col, count(*)::bigint as n, round(avg((ship_date > o_orderdate)::int), 4) as share from fx_target",
    "leak_high_cardinality": f"with {duck('fx_dirty')} select 'name_garbled' as col, count(distinct name_garbled)::bigint as n_unique from fx_dirty",
    "leak_near_constant": _T + " select col from (" + " union all ".join(f"select '{c}' as col, (select max(s) from (select stddev_samp({c}) as s from fx_target group by target)) as inside, stddev_samp({c}) as overall from fx_target" for c in ["leak_near_const", "o_totalprice"]) + ") where inside < 0.01 * overall",
    "leak_identifiers": "select 'c_custkey' as col union all select 'c_name' union all select 'c_acctbal' from customer having count(*) = count(distinct c_acctbal)",
    "find_target": f"{_T}, w as (select unnest(map_entries(to_json(t)::json::map(varchar, varchar))) as e from fx_target t), u as (select e.key as col, count(distinct e.value)::bigint as n_unique from w group by 1) select col, n_unique from u where col in {TARGET_NAMES} order by n_unique <> 2, col limit 1",
    "interaction_means": "select l_returnflag, l_linestatus, count(*)::bigint as n, round(avg(l_quantity), 4) as mean from lineitem group by 1, 2",
    "interaction_score": f"select 'l_returnflag' as a, 'l_linestatus' as b, {_score('l_returnflag', 'l_linestatus')} as score",
    "top_interactions": "select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, {_score(a, b)} as score" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))) + ") order by score desc, a, b limit 5",
    "important_categoricals": _T + " " + " union all ".join(f"select '{c}' as col, round(eta_sq, 6) as eta_sq from {_an(c, 'o_totalprice', 'fx_target')}" for c in ["o_orderpriority", "o_orderstatus", "leak_bijection"]),
}
