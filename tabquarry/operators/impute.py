"""Missingness evidence, the imputation methods, their distortion scores and the choice of a winner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.errors import ArithmeticException as SparkArithmeticException
from pyspark.errors import NumberFormatException as SparkNumberFormatException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nets
from .base import FIXTURES, clean, cut, duck, kurt, long_form, numeric_columns, over, running, skew, string_columns
from .neighbours import nearest_donor, nearest_rows
from .profile import _TEXT, MISSING

DROP_ABOVE, WARN_ABOVE, MAR_LIMIT = 0.50, 0.30, 0.15
FIT_ROWS = 4096  # rows that a deep imputer is fitted on


@dataclass
class Evidence:
    """What is known about a column's missing cells: numeric correlates, best categorical one, order key."""

    key: str
    correlates: list[str] = field(default_factory=list)
    group: str | None = None
    seed: int = 42


# --- evidence -----------------------------------------------------------------------------------------------------
def missing_summary(df: DataFrame) -> DataFrame:
    cells = long_form(clean(df), df.columns, "string").groupBy("col").agg(F.count_if(F.col("v").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))
    share = F.col("n_null") / F.col("n")
    verdict = F.when(share > DROP_ABOVE, "drop").when(share > WARN_ABOVE, "warn").otherwise("ok")
    return cells.select("col", "n_null", F.round(share, 4).alias("share"), verdict.alias("verdict"))


def mar_numeric(df: DataFrame, col: str, others: list[str]) -> DataFrame:
    """Correlation of the null flag with the other numeric columns (their nulls filled with the median)."""
    med = df.agg(*[F.median(c).alias(c) for c in others]).first()  # one row
    flag = F.col(col).isNull().cast("double")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) for c in others if med[c] is not None}
    base = df.select(flag.alias("__f"), *[e.alias(c) for c, e in filled.items()])
    safe = lambda c: F.try_divide(F.covar_pop("__f", c), F.stddev_pop("__f") * F.stddev_pop(c))
    one = base.agg(*[safe(c).alias(c) for c in filled])
    cells = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("other"), F.col(c).alias("r")) for c in filled])).alias("x")).select("x.*")
    return cells.where(F.abs("r") >= MAR_LIMIT).select(F.lit(col).alias("col"), "other", F.round("r", 4).alias("r"))


def mar_categorical(df: DataFrame, col: str, others: list[str]) -> DataFrame:
    """Spread of the null rate of ``col`` over the values of each other column."""
    flag = F.col(col).isNull().cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("other"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("v")) for c in others])
    rates = df.select(flag.alias("f"), F.explode(cells).alias("x")).groupBy("x.other", "x.v").agg(F.avg("f").alias("rate"))
    return rates.groupBy("other").agg(F.round(F.max("rate") - F.min("rate"), 4).alias("spread")).where(F.col("spread") >= MAR_LIMIT).select(F.lit(col).alias("col"), "other", "spread")


def mechanism(df: DataFrame, cols: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """MAR if any other column tells, else MNAR_suspected for numbers and MCAR for the rest."""
    found = None
    for c in cols:
        hits = mar_numeric(df, c, [x for x in numbers if x != c]).select("col").unionByName(mar_categorical(df, c, [x for x in texts if x != c]).select("col"))
        found = hits if found is None else found.unionByName(hits)
    every = df.sparkSession.createDataFrame([(c, c in numeric_columns(df)) for c in cols], "col string, numeric boolean")
    counts = found.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") > 0, "MAR").when(F.col("numeric"), "MNAR_suspected").otherwise("MCAR")
    return every.join(F.broadcast(counts), "col", "left").select("col", kind.alias("mechanism"))  # a row per column


def indicator_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = flags.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"p{i}", 4).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


# --- linear models from moments -----------------------------------------------------------------------------------
def ols(df: DataFrame, y: str, xs: list[str], ridge: float = 0.0) -> tuple[float, list[float], float, int]:
    """(intercept, slopes, residual standard deviation, n) on complete rows, from one aggregation of central moments."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs])).select(*[F.col(c).cast("double").alias(c) for c in [y, *xs]])
    cols = [*xs, y]
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j],
    ).first()  # fmt: skip  one row
    p = len(xs)
    if not one["n"]:
        return 0.0, [0.0] * p, 0.0, 0
    c = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    slopes = np.linalg.lstsq(c[:p, :p] + ridge * np.eye(p), c[:p, p], rcond=None)[0]
    mean = np.array([one[f"m{i}"] for i in range(p + 1)])
    left = max(0.0, c[p, p] - slopes @ c[:p, p])
    return float(mean[p] - slopes @ mean[:p]), slopes.tolist(), float(np.sqrt(left)), one["n"]


def _line(intercept: float, slopes: list[float], xs: list[str], fill: bool = False):
    out = F.lit(intercept)
    for b, x in zip(slopes, xs, strict=True):
        out = out + F.lit(b) * (F.coalesce(F.col(x).cast("double"), F.lit(0.0)) if fill else F.col(x).cast("double"))
    return out


# --- methods: (df, col, evidence) -> df with column <col>, or None if they do not apply ------------------------------
def _with(df: DataFrame, col: str, e) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), e))


def _scalar(df: DataFrame, e):
    return df.agg(e.alias("v")).first()["v"]  # one value


def _plain_value(df: DataFrame, col: str, method: str):
    if method == "mode":
        counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("c"))
        return _scalar(counts, F.min_by(col, F.struct(-F.col("c"), F.col(col))))
    return _scalar(df, (F.avg if method == "mean" else F.median)(col))


def mean(df: DataFrame, col: str, ev: Evidence) -> DataFrame:
    return _with(df, col, F.lit(_plain_value(df, col, "mean")))


def median(df: DataFrame, col: str, ev: Evidence) -> DataFrame:
    return _with(df, col, F.lit(_plain_value(df, col, "median")))


def mode(df: DataFrame, col: str, ev: Evidence) -> DataFrame:
    return _with(df, col, F.lit(_plain_value(df, col, "mode")))


def grouped_median(df: DataFrame, col: str, ev: Evidence) -> DataFrame:
    if not ev.group:
        return median(df, col, ev)
    med = df.where(F.col(ev.group).isNotNull()).groupBy(ev.group).agg(F.median(col).alias("__m"))
    return median(df.join(med, ev.group, "left").withColumn(col, F.coalesce(col, "__m")).select(*df.columns), col, ev)


def regression(df: DataFrame, col: str, ev: Evidence, noise: float = 0.0) -> DataFrame | None:
    xs = ev.correlates[:3]
    if not xs:
        return None
    a, b, s, n = ols(df, col, xs)
    if n < 10:
        return None
    guess = _line(a, b, xs) + (F.randn(ev.seed) * (noise * s) if noise else F.lit(0.0))
    return median(_with(df, col, guess), col, ev)


def stochastic_regression(df: DataFrame, col: str, ev: Evidence) -> DataFrame | None:
    return regression(df, col, ev, noise=0.5)


def pmm(df: DataFrame, col: str, ev: Evidence) -> DataFrame | None:
    """Observed value of the row whose prediction is nearest; rows without regressors stay null."""
    xs = ev.correlates[:3]
    if not xs:
        return None
    a, b, _, n = ols(df, col, xs)
    if n < 10:
        return None
    guessed = df.withColumn("__pred", _line(a, b, xs))
    return nearest_donor(guessed, ev.key, "__pred", col, "__donor").withColumn(col, F.coalesce(col, "__donor")).select(*df.columns)


def _neighbours(df: DataFrame, col: str, ev: Evidence, k: int, partly: bool = False) -> DataFrame:
    """Mean and first value of the k nearest donors, among complete rows or (``partly``) rows with any correlate observed."""
    full = df.where((" or " if partly else " and ").join(f"`{x}` is not null" for x in ev.correlates))
    donors, asking = full.where(F.col(col).isNotNull()), full.where(F.col(col).isNull())
    near = nearest_rows(asking, donors, ev.key, ev.correlates, k)
    values = donors.select(F.col(ev.key).cast("long").alias("other"), F.col(col).alias("__v"))
    return near.join(values, "other").groupBy(F.col("key").alias("__k")).agg(F.avg("__v").alias("__m"), F.min_by("__v", "rank").alias("__first"))


def knn(df: DataFrame, col: str, ev: Evidence, k: int = 5) -> DataFrame | None:
    """Mean of k neighbours by distance over the correlates both rows have; the mean of all where no donor shares one."""
    if not ev.correlates:
        return None
    found = _neighbours(df, col, ev, k, partly=True)
    filled = df.join(found, df[ev.key] == found["__k"], "left").withColumn(col, F.coalesce(col, "__m")).select(*df.columns)
    return _with(filled, col, F.lit(_scalar(df, F.avg(col))))


def knn_categorical(df: DataFrame, col: str, ev: Evidence, k: int = 5) -> DataFrame | None:
    """Codes of the sorted categories, imputed as numbers (``knn``), rounded, decoded."""
    if not ev.correlates:
        return None
    names = df.where(F.col(col).isNotNull()).select(F.col(col).alias("__name")).distinct()
    codes = cut(running(names, [], ["__name"], {"__upto": F.lit(1)}).select("__name", (F.col("__upto") - 1).cast("double").alias("__code")))
    n = codes.count()
    if not n:
        return df
    coded = df.join(codes, df[col] == codes["__name"], "left").withColumn(col, F.col("__code")).select(*df.columns)
    found = _neighbours(coded, col, ev, k, partly=True)
    at = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), F.bround(F.coalesce("__m", F.lit(_scalar(coded, F.avg(col)))))))
    near = df.join(found, df[ev.key] == found["__k"], "left").withColumn("__at", at)
    back = codes.select(F.col("__code").alias("__at"), F.col("__name").alias("__back"))
    return near.join(back, "__at", "left").withColumn(col, F.coalesce(col, "__back")).select(*df.columns)


def hotdeck(df: DataFrame, col: str, ev: Evidence) -> DataFrame:
    if not ev.correlates:
        return mode(df, col, ev)
    found = _neighbours(df, col, ev, 1)
    return df.join(found, df[ev.key] == found["__k"], "left").withColumn(col, F.coalesce(col, "__first")).select(*df.columns)


def em(df: DataFrame, col: str, ev: Evidence) -> DataFrame | None:
    """Fitted on observed rows only, so the first round is the fixed point; missing regressors count as 0."""
    xs = ev.correlates[:3]
    if not xs:
        return None
    a, b, _, n = ols(df.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in xs}), col, xs)
    return _with(df, col, _line(a, b, xs, fill=True)) if n >= 2 else None


def mice(df: DataFrame, col: str, ev: Evidence, rounds: int = 10, ridge: float = 1e-6) -> DataFrame | None:
    """Chained ridge equations over all numeric columns, from moments; all but ``col`` are put back."""
    cols = [c for c in numeric_columns(df) if c != ev.key]
    if len(cols) < 2:
        return None
    med = df.agg(*[F.median(c).alias(c) for c in cols]).first()
    holes = [c for c, n in zip(cols, df.agg(*[F.count_if(F.col(c).isNull()) for c in cols]).first(), strict=True) if n]
    work = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))) for c in cols})
    old: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        still = True
        for c in holes:
            xs = [f"__{x}" for x in cols if x != c]
            a, b, _s, n = ols(work.where(F.col(c).isNotNull()), f"__{c}", xs, ridge)
            fit = np.array([a, *b])
            still &= c in old and np.allclose(fit, old[c], rtol=1e-3, atol=1e-6)
            old[c] = fit
            work = work.withColumn(f"__{c}", F.when(F.col(c).isNotNull(), F.col(f"__{c}")).otherwise(_line(a, b, xs)))
        if still:
            break
        work = cut(work)
    return work.withColumn(col, F.coalesce(col, f"__{col}")).select(*df.columns)


def missforest(df: DataFrame, col: str, ev: Evidence, trees: int = 50) -> DataFrame | None:
    xs = [c for c in numeric_columns(df) if c not in (col, ev.key)]
    if not xs or df.where(F.col(col).isNotNull()).limit(10).count() < 10:
        return None
    med = df.agg(*[F.median(c).alias(c) for c in xs]).first()
    filled = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))) for c in xs}).withColumn("__(wanted)", F.col(col).cast("double"))
    vec = VectorAssembler(inputCols=[f"__{c}" for c in xs], outputCol="__(features)").transform(filled)
    model = RandomForestRegressor(featuresCol="__(features)", labelCol="__(wanted)", predictionCol="__(hat)", numTrees=trees, seed=ev.seed).fit(vec.where(F.col("`__(wanted)`").isNotNull()))
    return model.transform(vec).withColumn(col, F.coalesce(F.col(col).cast("double"), F.col("`__(hat)`"))).select(*df.columns)


def softimpute(df: DataFrame, col: str, ev: Evidence, rounds: int = 20) -> DataFrame | None:
    """Low-rank completion: standardise, shrink the singular values by half the largest, restore what is observed.

    The p x p Gram matrix is aggregated in Spark; its eigenvectors give each round's projection as column expressions.
    """
    cols = [c for c in numeric_columns(df) if c != ev.key]
    if len(cols) < 2:
        return None
    st = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    m, s = [float(st[f"m{i}"] or 0) for i in range(len(cols))], [float(st[f"s{i}"] or 0) or 1.0 for i in range(len(cols))]
    seen = {c: (F.col(c).cast("double") - m[i]) / s[i] for i, c in enumerate(cols)}
    w = df.withColumns({f"__{c}": F.coalesce(e, F.lit(0.0)) for c, e in seen.items()})
    p = len(cols)
    for r in range(rounds):
        g = w.agg(*[F.sum(F.col(f"__{cols[i]}") * F.col(f"__{cols[j]}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        gram = np.array([[g[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
        val, vec = np.linalg.eigh(gram)
        sv = np.sqrt(np.maximum(val, 0))
        keep = np.where(sv > 0, np.maximum(sv - 0.5 * sv.max(), 0) / np.where(sv > 0, sv, 1), 0)
        proj = vec @ np.diag(keep) @ vec.T
        new = {f"__{c}": F.coalesce(seen[c], sum((F.lit(float(proj[i, j])) * F.col(f"__{cols[i]}") for i in range(p)), F.lit(0.0))) for j, c in enumerate(cols)}
        w = w.withColumns(new)
        if r % 5 == 4:
            w = cut(w)
    i = cols.index(col)
    return w.withColumn(col, F.coalesce(F.col(col), F.col(f"__{col}") * s[i] + m[i])).select(*df.columns)


def deep(fit_net: Callable) -> Callable:
    """An imputer from a network over all numeric columns but the key.

    Moments are taken over all rows; the network is fitted on at most FIT_ROWS rows, those of the smallest hashes of the
    key, and fills every row in Arrow batches.
    """

    def fill(df: DataFrame, col: str, ev: Evidence) -> DataFrame | None:
        cols = [c for c in numeric_columns(df) if c != ev.key]
        if col not in cols or len(cols) < 2:
            return None
        flat = clean(df, cols).select(ev.key, *[F.col(c).cast("double").alias(c) for c in cols])
        st = flat.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        mean, sd = np.array([st[f"m{i}"] or 0.0 for i in range(len(cols))]), np.array([st[f"s{i}"] or 1.0 for i in range(len(cols))])
        if st[f"m{cols.index(col)}"] is None:
            return None
        known = flat.orderBy(F.xxhash64(F.col(ev.key), F.lit(ev.seed)), *cols).limit(FIT_ROWS).toPandas()[cols].to_numpy(dtype=float)
        net = fit_net(np.nan_to_num((known - mean) / sd), (~np.isnan(known)).astype(float), ev.seed)
        at = cols.index(col)

        @F.pandas_udf("double")
        def value(*cells: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cells])
            return pd.Series(net(np.nan_to_num((x - mean) / sd), (~np.isnan(x)).astype(float))[:, at] * sd[at] + mean[at])

        return _with(clean(df, [col]), col, value(*[F.col(c).cast("double") for c in cols]))

    return fill


METHODS: dict[str, Callable] = {
    "mean": mean, "median": median, "mode": mode, "grouped_median": grouped_median, "knn": knn, "regression": regression,
    "stochastic_regression": stochastic_regression, "pmm": pmm, "hotdeck": hotdeck, "mice": mice, "missforest": missforest, "em": em,
    "softimpute": softimpute, "gain": deep(nets.fit_gain), "mida": deep(nets.fit_mida), "hivae": deep(nets.fit_hivae),
}


def apply(df: DataFrame, col: str, method: str, ev: Evidence) -> tuple[DataFrame, str]:
    """(imputed, method used): a method that is unknown, not applicable or fails falls back to median or mode.

    A method fails by what it raises itself, on numbers or types; errors of the cluster are not taken for that.
    """
    if method == "drop_rows":
        return df.where(F.col(col).isNotNull()), method
    out = None
    if method in METHODS:
        try:
            out = METHODS[method](df, col, ev)
        except (ValueError, TypeError, ArithmeticError, np.linalg.LinAlgError, AnalysisException, SparkArithmeticException, SparkNumberFormatException):
            out = None  # the fallback is recorded in the name returned
    if out is not None:
        return out, method
    plain = "median" if col in numeric_columns(df) else "mode"
    return METHODS[plain](df, col, ev), f"fallback_{plain}"


def fit(df: DataFrame, col: str, method: str, ev: Evidence) -> tuple[Callable[[DataFrame], DataFrame], str]:
    """(what fills a frame from what ``df`` has, method used).

    Means, medians, modes and lines are kept as numbers, medians of groups as a table. The other methods take their donors or
    their model from the rows of ``df``: a frame to fill joins them with its own values of ``col`` hidden, so that none
    of them counts. Its keys must not be those of ``df``.
    """
    filled, used = apply(df, col, method, ev)
    if used == "drop_rows":
        return (lambda d: d.where(F.col(col).isNotNull())), used
    plain = used.removeprefix("fallback_")
    if plain in ("mean", "median", "mode"):
        value = _plain_value(df, col, plain)
        return (lambda d: _with(d, col, F.lit(value))), used
    if plain == "grouped_median" and ev.group:
        med = cut(df.where(F.col(ev.group).isNotNull()).groupBy(ev.group).agg(F.median(col).alias("__m")))
        rest = _plain_value(df, col, "median")
        return (lambda d: d.join(med, ev.group, "left").withColumn(col, F.coalesce(col, "__m", F.lit(rest))).select(*d.columns)), used
    if plain in ("regression", "stochastic_regression"):
        xs = ev.correlates[:3]
        a, b, s, _ = ols(df, col, xs)
        rest, noise = _plain_value(df, col, "median"), 0.5 * s if plain == "stochastic_regression" else 0.0
        return (lambda d: _with(d, col, F.coalesce(_line(a, b, xs) + (F.randn(ev.seed) * noise if noise else F.lit(0.0)), F.lit(rest)))), used
    if plain == "em":
        xs = ev.correlates[:3]
        a, b, _, _ = ols(df.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in xs}), col, xs)
        return (lambda d: _with(d, col, _line(a, b, xs, fill=True))), used

    def from_rows(d: DataFrame) -> DataFrame:
        own = F.struct(F.col(col).alias("v"))  # no number of its own, lest methods take it for a regressor
        hidden = d.withColumns({"__own": own, "__new": F.lit(True), col: F.lit(None).cast(d.schema[col].dataType)})
        known = df.withColumns({"__own": own, "__new": F.lit(False)})
        out = apply(known.unionByName(hidden), col, plain, ev)[0]
        return out.where("__new").withColumn(col, F.coalesce("__own.v", col)).select(*d.columns)

    return from_rows, used


def select_methods(df: DataFrame, col: str, share: float, ev: Evidence) -> list[str]:
    """Candidates by rule from type, share of nulls and correlates."""
    if col not in numeric_columns(df):
        return ["mode", "knn", "hotdeck"] if ev.correlates else ["mode"]
    plain = ["mean", "median"] + ["grouped_median"] * bool(ev.group)
    if ev.correlates:
        plain += ["regression", "pmm"] if share < 0.3 else ["mice", "missforest"]
    return plain[:5]


# --- distortion ---------------------------------------------------------------------------------------------------
def ks_statistic(df: DataFrame, value: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Two-sample statistic between group = 1 and group = 0: largest difference of the distribution functions."""
    by = by or []
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b"))
    totals = g.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = running(g, by, [value], {"ca": F.col("a"), "cb": F.col("b")})
    met = run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))  # one row
    diff = F.abs(F.try_divide(F.col("ca").cast("double"), F.col("na")) - F.try_divide(F.col("cb").cast("double"), F.col("nb")))
    return met.groupBy(*by).agg(F.max(diff).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def before_after(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    one = lambda d, t: d.select(F.col(col).cast("double").alias("v"), F.lit(t).alias("after"))
    return one(before, 0).unionByName(one(after, 1)).where("v is not null")


def marginal_distortion(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Shift of mean and spread over the old spread, 0.3 KS, 0.1 shape; their sum is the total."""
    both = before_after(before, after, col)
    per = both.groupBy("after").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), skew("v").alias("sk"), kurt("v").alias("ku"))
    at = lambda t, c: F.max(F.when(F.col("after") == t, F.col(c)))
    one = per.agg(*[at(t, c).alias(f"{c}{t}") for t in (0, 1) for c in ("m", "s", "sk", "ku")])
    shape = F.abs(F.col("sk1") - F.col("sk0")) + F.abs(F.col("ku1") - F.col("ku0")) / (F.abs("ku0") + 1)
    ks = ks_statistic(both, "v", "after").select("ks")
    out = one.crossJoin(ks).select(  # one row each
        (F.abs(F.col("m1") - F.col("m0")) / F.col("s0")).alias("mean_shift"), (F.abs(F.col("s1") - F.col("s0")) / F.col("s0")).alias("spread_shift"), "ks", shape.alias("shape")
    )
    total = F.col("mean_shift") + F.col("spread_shift") + 0.3 * F.col("ks") + 0.1 * F.col("shape")
    return out.withColumn("total", total)


def regression_distortion(before: DataFrame, after: DataFrame, col: str, x: str) -> DataFrame:
    def fit(d, t):
        return d.where(F.col(col).isNotNull() & F.col(x).isNotNull()).agg(F.regr_slope(col, x).alias(f"b{t}"), F.regr_r2(col, x).alias(f"r{t}"))

    met = fit(before, 0).crossJoin(fit(after, 1))  # one row each
    return met.select((F.abs(F.col("b1") - F.col("b0")) / (F.abs("b0") + 1e-8)).alias("slope_shift"), F.abs(F.col("r1") - F.col("r0")).alias("r2_shift"))


def total_variation(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Half the summed differences of the category shares."""
    one = lambda d, t: d.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("t", F.lit(t))
    both = one(before, 0).unionByName(one(after, 1))
    n = both.groupBy("t").agg(F.sum("c").alias("n"))
    share = both.join(F.broadcast(n), "t").groupBy("v").agg(F.sum(F.when(F.col("t") == 1, 1.0).otherwise(-1.0) * F.col("c") / F.col("n")).alias("d"))  # two rows
    return share.agg((F.sum(F.abs("d")) / 2).alias("tvd"))


def scores(df: DataFrame, col: str, methods: list[str], ev: Evidence) -> DataFrame:
    """(method, total) of each candidate, smallest first is the winner."""
    out = None
    for m in methods:
        done, used = apply(df, col, m, ev)
        one = marginal_distortion(df, done, col).select(F.lit(m).alias("method"), F.lit(used).alias("used"), F.round("total", 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


FIXTURES["fx_part"] = "SELECT p_partkey, p_size, p_brand, p_retailprice, CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_retailprice + p_size END AS price, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE p_brand END AS brand FROM part"
FIXTURES["fx_events"] = "SELECT event_id, CAST(user_id AS DOUBLE) AS u, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS y FROM events"
PART = Evidence("p_partkey", ["p_size", "p_retailprice"])
LINE = Evidence("l_orderkey", ["l_quantity"], "l_returnflag")


def _sums(col: str, method: str, ev: Evidence = LINE):
    """Groupwise sums of an imputed column: they change if any cell does."""

    def run(d: DataFrame) -> DataFrame:
        out, used = apply(d, col, method, ev)
        value = F.sum(F.col(col)) if col in numeric_columns(d) else F.count_if(F.col(col) == "A").cast("double")
        return out.groupBy("l_returnflag").agg(F.count(col).alias("n"), F.round(value, 2).alias("total")).withColumn("used", F.lit(used))

    return run


def _rows(col: str, method: str, ev: Evidence = PART):
    def run(d: DataFrame) -> DataFrame:
        out, _ = apply(d, col, method, ev) if method != "knn_categorical" else (knn_categorical(d, col, ev), "")
        value = F.round(F.col(col), 4) if col in numeric_columns(d) else F.col(col)
        return out.select(ev.key, value.alias(col))

    return run


def _deep(method: str):
    """Every cell of y_mcar that was missing; y_true is not among the columns the network sees."""

    def run(d: DataFrame) -> DataFrame:
        part = d.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_tax", "y_mcar")
        marked = part.withColumn("gone", F.col("y_mcar").isNull())
        out, used = apply(marked, "y_mcar", method, Evidence("l_orderkey"))
        return out.where("gone").select("l_orderkey", "l_linenumber", F.col("y_mcar").alias("y"), F.lit(used).alias("used"))

    return run


QUERIES = {
    "missing_summary": over("fx_missing", missing_summary),
    "mar_numeric": over("fx_missing", lambda d: mar_numeric(d, "y_mar_num", ["l_quantity", "l_tax", "l_partkey", "y_true", "y_mcar"])),
    "mar_categorical": over("fx_missing", lambda d: mar_categorical(d, "y_mar_cat", ["l_returnflag", "flag_missing"])),
    "mechanism": over("fx_missing", lambda d: mechanism(d, ["y_mcar", "y_mar_num", "y_mar_cat", "flag_missing"], ["l_quantity", "l_tax"], ["l_returnflag"])),
    "indicator_correlation": over("fx_missing", lambda d: indicator_correlation(d, ["y_mcar", "y_mar_num", "y_mar_cat", "y_sparse", "flag_missing"])),
    "impute_mean": over("fx_missing", _sums("y_mcar", "mean")),
    "impute_median": over("fx_missing", _sums("y_mcar", "median")),
    "impute_mode": over("fx_missing", _sums("flag_missing", "mode")),
    "impute_grouped_median": over("fx_missing", _sums("y_mcar", "grouped_median")),
    "impute_regression": over("fx_missing", _sums("y_mar_num", "regression")),
    "impute_em": over("fx_missing", _sums("y_mar_num", "em")),
    "impute_drop_rows": over("fx_missing", _sums("y_mar_cat", "drop_rows")),
    **{f"impute_{m}": over("fx_missing", _deep(m)) for m in ("gain", "mida", "hivae")},
    "impute_fallback": over("fx_missing", _sums("y_mcar", "no_such_method")),
    "impute_stochastic_regression": over("fx_missing", lambda d: apply(d, "y_mar_num", "stochastic_regression", LINE)[0].agg(F.count("y_mar_num").alias("n"))),
    "impute_knn": over("fx_part", _rows("price", "knn")),
    "impute_knn_categorical": over("fx_part", _rows("brand", "knn_categorical")),
    "impute_hotdeck": over("fx_part", _rows("price", "hotdeck")),
    "impute_pmm": over("fx_events", lambda d: apply(d, "y", "pmm", Evidence("event_id", ["u"]))[0].select("event_id", F.round("y", 4).alias("y"))),
    "nearest_donor": over("fx_events", lambda d: nearest_donor(d, "event_id", "u", "y", "donor").select("event_id", F.coalesce("y", "donor").alias("y"))),
    "impute_mice": over("fx_missing", lambda d: apply(d.select("l_orderkey", "l_quantity", "y_mcar", "y_mar_num"), "y_mar_num", "mice", LINE)[0].agg(F.count("y_mar_num").alias("n"), F.round(F.avg("y_mar_num"), 2).alias("mean"))),
    "impute_missforest": over("fx_part", lambda d: apply(d, "price", "missforest", PART)[0].agg(F.count("price").alias("n"))),
    "impute_softimpute": over("fx_part", lambda d: apply(d, "price", "softimpute", PART)[0].agg(F.count("price").alias("n"))),
    "ks_two_sample": over("events", lambda d: ks_statistic(d.where("event_type in ('click', 'view')").withColumn("g", (F.col("event_type") == "click").cast("int")), "value", "g").select(F.round("ks", 6).alias("ks"), "n_a", "n_b")),
    "score_marginal": over("fx_missing", lambda d: marginal_distortion(d, median(d, "y_mar_num", LINE), "y_mar_num").select(*[F.round(c, 4).alias(c) for c in ("mean_shift", "spread_shift", "ks", "shape", "total")])),
    "score_regression": over("fx_missing", lambda d: regression_distortion(d, median(d, "y_mar_num", LINE), "y_mar_num", "l_quantity").select(F.round("slope_shift", 4).alias("slope_shift"), F.round("r2_shift", 4).alias("r2_shift"))),
    "score_total_variation": over("fx_missing", lambda d: total_variation(d, mode(d, "flag_missing", LINE), "flag_missing").select(F.round("tvd", 6).alias("tvd"))),
    "imputation_winner": over("fx_missing", lambda d: scores(d, "y_mar_num", ["mean", "median", "regression"], LINE).agg(F.min_by("method", "total").alias("winner"))),
}

_M = f"with {duck('fx_missing')}"
_imp = lambda e, m: f"{_M} select l_returnflag, count(x)::bigint as n, round(sum(x), 2) as total, '{m}' as used from (select l_returnflag, {e} as x from fx_missing) group by 1"
_flag_r = lambda c, x: f"(select coalesce(abs(corr(({c} is null)::int, coalesce({x}, (select median({x}) from fx_missing)))), 0) from fx_missing)"
_flag_spread = lambda c, x: f"(select max(r) - min(r) from (select avg(({c} is null)::int) as r from fx_missing group by coalesce({x}, '__missing__')))"
_line_sql = lambda m: f"{_M}, f as (select regr_slope(y_mar_num, l_quantity) as b, regr_intercept(y_mar_num, l_quantity) as a from fx_missing) select l_returnflag, count(*)::bigint as n, round(sum(coalesce(y_mar_num, a + b * l_quantity)), 2) as total, '{m}' as used from fx_missing, f group by 1"
_near = f"""with {duck('fx_part')}, p as (select a.p_partkey, b.p_partkey as other, b.price, b.brand, row_number() over (partition by a.p_partkey order by round(sqrt((a.p_size - b.p_size)**2 + (a.p_retailprice - b.p_retailprice)**2), 9), b.p_partkey) as k
 from fx_part a join fx_part b on a.p_partkey <> b.p_partkey where """
_total = lambda e: f"""with t as (select y_mar_num as v, 0 as t from fx_missing where y_mar_num is not null union all select coalesce(y_mar_num, {e}), 1 from fx_missing, f),
 s as (select t, avg(v) as m, stddev_samp(v) as s, skewness(v) as sk, kurtosis(v) as ku from t group by t), g as (select v, count(*) filter (where t = 1) as a, count(*) filter (where t = 0) as b from t group by v),
 c as (select max(abs(fa - fb)) as ks from (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb from g))
 select round(abs(y.m - x.m) / x.s + abs(y.s - x.s) / x.s + 0.3 * ks + 0.1 * (abs(y.sk - x.sk) + abs(y.ku - x.ku) / (abs(x.ku) + 1)), 4) from s x, s y, c where x.t = 0 and y.t = 1"""  # noqa: E731
_donor = f"""with {duck('fx_events')}, d as (select u, arg_min(y, event_id) as y, min(event_id) as k from fx_events where y is not null group by u),
r as (select f.event_id, d.y, row_number() over (partition by f.event_id order by abs(d.u - f.u), d.k) as n from fx_events f, d where f.y is null)
select f.event_id, coalesce(f.y, r.y) as y from fx_events f left join r on f.event_id = r.event_id and r.n = 1"""
ORACLE = {
    "missing_summary": f"""{_M} select col, n_null, round(n_null / n, 4) as share, case when n_null / n > 0.5 then 'drop' when n_null / n > 0.3 then 'warn' else 'ok' end as verdict
 from (select col, (count(*) - count(v))::bigint as n_null, count(*) as n from ({_TEXT('fx_missing', MISSING)}) group by col)""",
    "mar_numeric": _M + " select * from (" + " union all ".join(f"select 'y_mar_num' as col, '{c}' as other, round(corr((y_mar_num is null)::int, coalesce({c}, (select median({c}) from fx_missing))), 4) as r from fx_missing" for c in ["l_quantity", "l_tax", "l_partkey", "y_true", "y_mcar"]) + ") where abs(r) >= 0.15",
    "mar_categorical": _M + " select * from (" + " union all ".join(f"select 'y_mar_cat' as col, '{c}' as other, round(max(r) - min(r), 4) as spread from (select avg((y_mar_cat is null)::int) as r from fx_missing group by coalesce({c}, '__missing__'))" for c in ["l_returnflag", "flag_missing"]) + ") where spread >= 0.15",
    "mechanism": _M + " " + " union all ".join(
        f"select '{c}' as col, case when greatest({', '.join(_flag_r(c, x) for x in ('l_quantity', 'l_tax') if x != c)}, {_flag_spread(c, 'l_returnflag')}) >= 0.15 then 'MAR' else '{plain}' end as mechanism"
        for c, plain in (("y_mcar", "MNAR_suspected"), ("y_mar_num", "MNAR_suspected"), ("y_mar_cat", "MNAR_suspected"), ("flag_missing", "MCAR"))
    ),
    "indicator_correlation": _M + " " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr(({a} is null)::int, ({b} is null)::int), 4) as r from fx_missing" for i, a in enumerate(["y_mcar", "y_mar_num", "y_mar_cat", "y_sparse", "flag_missing"]) for b in ["y_mcar", "y_mar_num", "y_mar_cat", "y_sparse", "flag_missing"][i + 1 :]),
    "impute_mean": _imp("coalesce(y_mcar, (select avg(y_mcar) from fx_missing))", "mean"),
    "impute_median": _imp("coalesce(y_mcar, (select median(y_mcar) from fx_missing))", "median"),
    "impute_fallback": _imp("coalesce(y_mcar, (select median(y_mcar) from fx_missing))", "fallback_median"),
    "impute_mode": f"{_M}, m as (select flag_missing as m from fx_missing where flag_missing is not null group by 1 order by count(*) desc, 1 limit 1) select l_returnflag, count(coalesce(flag_missing, m))::bigint as n, count(*) filter (where coalesce(flag_missing, m) = 'A')::double as total, 'mode' as used from fx_missing, m group by 1",
    "impute_grouped_median": f"{_M} select l_returnflag, count(*)::bigint as n, round(sum(coalesce(y_mcar, md)), 2) as total, 'grouped_median' as used from (select *, median(y_mcar) over (partition by l_returnflag) as md from fx_missing) group by 1",
    "impute_regression": _line_sql("regression"),
    "impute_em": _line_sql("em"),
    "impute_drop_rows": f"{_M} select l_returnflag, count(*)::bigint as n, round(sum(y_mar_cat), 2) as total, 'drop_rows' as used from fx_missing where y_mar_cat is not null group by 1",
    "impute_stochastic_regression": "select count(*)::bigint as n from lineitem",
    "impute_missforest": "select count(*)::bigint as n from part",
    "impute_softimpute": "select count(*)::bigint as n from part",
    "impute_knn": _near + "a.price is null and b.price is not null) select f.p_partkey, round(coalesce(f.price, m.v), 4) as price from fx_part f left join (select p_partkey, avg(price) as v from p where k <= 5 group by 1) m using (p_partkey)",
    "impute_hotdeck": _near + "a.price is null and b.price is not null) select f.p_partkey, round(coalesce(f.price, p.price), 4) as price from fx_part f left join p on p.p_partkey = f.p_partkey and k = 1",
    "impute_knn_categorical": _near + "a.brand is null and b.brand is not null), c as (select brand, dense_rank() over (order by brand) - 1 as code from (select distinct brand from fx_part where brand is not null)), m as (select p_partkey, round_even(avg(code), 0)::int as code from p join c using (brand) where k <= 5 group by 1) select f.p_partkey, coalesce(f.brand, c.brand) as brand from fx_part f left join m using (p_partkey) left join c on c.code = m.code",
    "nearest_donor": _donor,
    "ks_two_sample": """with t as (select value as v, (event_type = 'click')::int as a, (event_type = 'view')::int as b from events where event_type in ('click', 'view')), g as (select v, sum(a) as a, sum(b) as b from t group by v),
 c as (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb, sum(a) over () as na, sum(b) over () as nb from g) select round(max(abs(fa - fb)), 6) as ks, max(na)::bigint as n_a, max(nb)::bigint as n_b from c""",
    "score_marginal": f"""{_M}, t as (select y_mar_num as v, 0 as t from fx_missing where y_mar_num is not null union all select coalesce(y_mar_num, (select median(y_mar_num) from fx_missing)), 1 from fx_missing),
 s as (select t, avg(v) as m, stddev_samp(v) as s, skewness(v) as sk, kurtosis(v) as ku from t group by t), g as (select v, count(*) filter (where t = 1) as a, count(*) filter (where t = 0) as b from t group by v),
 c as (select max(abs(fa - fb)) as ks from (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb from g)),
 o as (select abs(y.m - x.m) / x.s as ms, abs(y.s - x.s) / x.s as ss, abs(y.sk - x.sk) + abs(y.ku - x.ku) / (abs(x.ku) + 1) as sh from s x, s y where x.t = 0 and y.t = 1)
 select round(ms, 4) as mean_shift, round(ss, 4) as spread_shift, round(ks, 4) as ks, round(sh, 4) as shape, round(ms + ss + 0.3 * ks + 0.1 * sh, 4) as total from o, c""",
    "score_regression": f"""{_M}, m as (select median(y_mar_num) as md from fx_missing), a as (select regr_slope(y_mar_num, l_quantity) as b0, regr_r2(y_mar_num, l_quantity) as r0, regr_slope(coalesce(y_mar_num, md), l_quantity) as b1, regr_r2(coalesce(y_mar_num, md), l_quantity) as r1 from fx_missing, m)
 select round(abs(b1 - b0) / (abs(b0) + 1e-8), 4) as slope_shift, round(abs(r1 - r0), 4) as r2_shift from a""",
    "score_total_variation": f"""{_M}, m as (select flag_missing as m from fx_missing where flag_missing is not null group by 1 order by count(*) desc, 1 limit 1), a as (select flag_missing as v, count(*) / sum(count(*)) over () as p from fx_missing where flag_missing is not null group by 1),
 b as (select coalesce(flag_missing, m) as v, count(*) / sum(count(*)) over () as q from fx_missing, m group by 1) select round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) as tvd from a full join b using (v)""",
    "imputation_winner": f"{_M}, f as (select regr_slope(y_mar_num, l_quantity) as b, regr_intercept(y_mar_num, l_quantity) as a, avg(y_mar_num) as mn, median(y_mar_num) as md from fx_missing), w as ("
    + " union all ".join(f"select '{m}' as method, ({_total(e)}) as total" for m, e in (("mean", "mn"), ("median", "md"), ("regression", "a + b * l_quantity")))
    + ") select method as winner from w order by total limit 1",
}
