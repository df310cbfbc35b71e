"""Distribution tests and fits, model assumptions, stability over segments, splits."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import specfun
from .base import FIXTURES, clean, duck, kurt, long_form, numeric_columns, over, ratio, running, skew
from .impute import ks_statistic
from .relations import anova, r4, with_p

PSI_FLOOR, PSI_BINS, SHAPIRO_ROWS = 1e-4, 10, 5000


# --- distributions ------------------------------------------------------------------------------------------------
def shape_tag(c):
    return F.when(c < -1, "strong_left").when(c < -0.5, "left").when(c <= 0.5, "symmetric").when(c <= 1, "right").otherwise("strong_right")


def bin_count(n):
    return F.when(n < 10, 5).otherwise(F.least(F.greatest(F.ceil(F.log2(n.cast("double")) + 1), F.lit(10)), F.lit(50)))


def shapes(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = long_form(clean(df, cols), cols).groupBy("col").agg(F.count("v").alias("n"), skew("v").alias("s"))
    return cells.select("col", F.round("s", 4).alias("skew"), shape_tag(F.col("s")).alias("shape"), bin_count(F.col("n")).cast("int").alias("bins"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, n): equal widths, the last bin closed."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    return counts


def density(df: DataFrame, col: str, points: int = 300) -> DataFrame:
    """Gaussian kernel density on a grid, with Scott's bandwidth, from counts of distinct values."""
    v = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n, lo, hi, sd = v.agg(F.sum("c"), F.min("v"), F.max("v"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("c") * F.col("v") ** 2) / F.sum("c") - (F.sum(F.col("c") * F.col("v")) / F.sum("c")) ** 2))).first()
    h = (sd * math.sqrt(n / max(1, n - 1)) * n ** (-0.2)) or 1.0
    grid = np.linspace(lo, hi, points)

    def partial(batches):
        total = np.zeros(points)
        for b in batches:
            x, c = b["v"].to_numpy(), b["c"].to_numpy()
            for i in range(0, len(x), 2048):
                total += (np.exp(-0.5 * ((grid[None] - x[i : i + 2048, None]) / h) ** 2) * c[i : i + 2048, None]).sum(0)
        yield pd.DataFrame({"i": range(points), "x": grid, "s": total})

    part = v.mapInPandas(partial, "i int, x double, s double")
    return part.groupBy("i", "x").agg((F.sum("s") / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def jarque_bera(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = long_form(clean(df, cols), cols).groupBy("col").agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    jb = F.col("n") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    return cells.select("col", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def dagostino(df: DataFrame, cols: list[str]) -> DataFrame:
    """K2 of D'Agostino and Pearson from population moments; at least 20 values."""
    m = long_form(clean(df, cols), cols).groupBy("col").agg(F.count("v").cast("double").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")).where("n >= 20")
    n, b2 = F.col("n"), F.col("g2") + 3
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / sb**2))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return m.select("col", k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def anderson_darling(df: DataFrame, col: str) -> DataFrame:
    """A2 against the 5% critical value for a fitted normal, from a distributed rank."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    n, m, s = v.agg(F.count("v"), F.avg("v"), F.stddev_samp("v")).first()
    if n < 3 or not s:
        return df.sparkSession.createDataFrame([], "n long, a2 double, normal boolean")
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    at = running(counts, [], ["v"], {"upto": F.col("c")})

    @F.pandas_udf("double")
    def log_cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda t: math.log(max(1e-300, specfun.normal_cdf(t))))

    z = (F.col("v") - F.lit(m)) / F.lit(s)
    # ranks i of a tied value run from upto - c + 1 to upto: sums of 2i - 1 over them
    odd = F.col("upto") ** 2 - (F.col("upto") - F.col("c")) ** 2
    rest = F.col("c") * 2 * n - odd
    a2 = at.agg((-F.lit(float(n)) - F.sum(odd * log_cdf(z) + rest * log_cdf(-z)) / n).alias("a2"))
    return a2.select(F.lit(n).alias("n"), "a2", (F.col("a2") < 0.787 / (1 + 4 / n - 25 / n**2)).alias("normal"))


def shapiro(df: DataFrame, col: str, order: str) -> DataFrame:
    """W and p of the first 5000 rows, the bound of the approximation."""
    first = df.where(F.col(col).isNotNull()).orderBy(order).limit(SHAPIRO_ROWS).select(F.col(col).cast("double")).toPandas()[col]
    w, p = specfun.shapiro_wilk(first) if len(first) >= 3 else (None, None)
    return df.sparkSession.createDataFrame([(len(first), w, p)], "n int, w double, p double")


def normality_vote(df: DataFrame, col: str, order: str, level: float = 0.05) -> DataFrame:
    """Strict majority of Shapiro-Wilk, Anderson-Darling, Jarque-Bera and D'Agostino."""
    votes = shapiro(df, col, order).select((F.col("p") > level).alias("v")).unionByName(anderson_darling(df, col).select(F.col("normal").alias("v")))
    votes = votes.unionByName(jarque_bera(df, [col]).select((F.col("p") > level).alias("v"))).unionByName(dagostino(df, [col]).select((F.col("p") > level).alias("v")))
    return votes.agg(F.count("v").alias("tests"), F.count_if("v").alias("normal_votes")).withColumn("normal", 2 * F.col("normal_votes") > F.col("tests"))


def _beta_shape(m: float, var: float, g1: float, g2: float) -> tuple[float, float]:
    """Shape of a beta on (0, 1) from mean and variance, then Newton steps on the mean logs of x and 1 - x."""
    t = max(m * (1 - m) / var - 1, 1e-3)
    a, b = m * t, (1 - m) * t
    slope = lambda x: (specfun.digamma(x * (1 + 1e-5)) - specfun.digamma(x * (1 - 1e-5))) / (2e-5 * x)
    for _ in range(30):
        p, ta, tb, tp = specfun.digamma(a + b), slope(a), slope(b), slope(a + b)
        fa, fb, det = specfun.digamma(a) - p - g1, specfun.digamma(b) - p - g2, ta * tb - tp * (ta + tb)
        if not det:
            break
        da, db = ((tb - tp) * fa + tp * fb) / det, (tp * fa + (ta - tp) * fb) / det
        a, b = max(a - da, a / 4), max(b - db, b / 4)
    return a, b


def best_fit(df: DataFrame, col: str) -> DataFrame:
    """Normal, lognormal, exponential, gamma and beta; the one of least Kolmogorov distance first.

    Fitted by likelihood in closed forms and Newton steps on means and mean logs: beta on the observed range, widened by a
    part of 1 / n, lognormal and gamma from 0 where all values are positive. With a location, which values below 0 need,
    lognormal and gamma match mean, variance and skewness (0.1 at least, as neither leans left); the nearer fit of a family
    counts.
    """
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    pos = F.when(F.col("v") > 0, F.log("v"))
    n, m, s, lo, ml, sl, npos = v.agg(F.count("v"), F.avg("v"), F.stddev_pop("v"), F.min("v"), F.avg(pos), F.stddev_pop(pos), F.count(pos)).first()
    fits: dict[str, tuple] = {"norm": (m, s or 1e-9), "expon": (lo, max(m - lo, 1e-9))}
    if npos == n and n and sl:
        fits["lognorm"] = (ml, sl)
        gap = math.log(m) - ml
        k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap) if gap > 0 else 1.0
        for _ in range(20):
            h = 1e-5 * k
            k -= (math.log(k) - specfun.digamma(k) - gap) / (1 / k - (specfun.digamma(k + h) - specfun.digamma(k - h)) / (2 * h))
        fits["gamma"] = (k, m / k)
    cdf = {
        "norm": lambda x, a, b: specfun.normal_cdf((x - a) / b), "expon": lambda x, a, b: 1 - math.exp(-max(0.0, x - a) / b),
        "lognorm": lambda x, a, b: specfun.normal_cdf((math.log(x) - a) / b) if x > 0 else 0.0, "gamma": lambda x, a, b: 1 - specfun.gamma_q(a, max(x, 0) / b),
        "lognorm, shifted": lambda x, a, b, at: specfun.normal_cdf((math.log(x - at) - a) / b) if x > at else 0.0,
        "gamma, shifted": lambda x, a, b, at: 1 - specfun.gamma_q(a, max(x - at, 0) / b), "beta": lambda x, a, b, at, w: specfun.beta_inc(a, b, (x - at) / w),
    }
    if n and s:
        skew = max(0.1, v.agg(F.skewness("v")).first()[0])
        fits["gamma, shifted"] = (4 / skew**2, s * skew / 2, m - 2 * s / skew)
        # (w + 2) sqrt(w - 1) is the skewness at w = exp(sigma^2)
        root = np.cbrt(1 + skew**2 / 2 + skew * math.sqrt(1 + skew**2 / 4))
        w = float(root + 1 / root - 1)
        scale = s / math.sqrt(w * (w - 1))
        fits["lognorm, shifted"] = (math.log(scale), math.sqrt(math.log(w)), m - scale * math.sqrt(w))
        hi = v.agg(F.max("v")).first()[0]
        edge = 0.5 * (hi - lo) / n
        lo_b, wide = lo - edge, hi - lo + 2 * edge
        x = (F.col("v") - F.lit(lo_b)) / F.lit(wide)
        g1, g2 = v.agg(F.avg(F.log(x)), F.avg(F.log1p(-x))).first()
        fits["beta"] = (*_beta_shape((m - lo_b) / wide, (s / wide) ** 2, g1, g2), lo_b, wide)
    names = list(fits)
    counts = running(v.groupBy("v").agg(F.count(F.lit(1)).alias("c")), [], ["v"], {"upto": F.col("c")})

    def far(batches):
        for b in batches:
            rows = []
            for name in names:
                f = np.array([cdf[name](x, *fits[name]) for x in b["v"]])
                d = np.maximum(np.abs(b["upto"] / n - f), np.abs((b["upto"] - b["c"]) / n - f))
                rows.append((name, float(d.max()) if len(d) else 0.0))
            yield pd.DataFrame(rows, columns=["name", "ks"])

    fitted = counts.mapInPandas(far, "name string, ks double").groupBy("name").agg(F.max("ks").alias("ks"))
    return fitted.groupBy(F.substring_index("name", ",", 1).alias("name")).agg(F.min("ks").alias("ks")).orderBy("ks", "name")


def rare_categories(df: DataFrame, col: str, share: float = 0.01, least: int = 10) -> DataFrame:
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).where((F.col("n") / F.col("t") < share) | (F.col("n") < least)).select("value", "n")  # one row


def monthly(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


# --- assumptions --------------------------------------------------------------------------------------------------
def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median-centred: ANOVA on distances to the group's median."""
    med = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.median(value).alias("__m"))
    out = anova(df.join(med, group).withColumn(value, F.abs(F.col(value) - F.col("__m"))), group, value)
    verdict = F.when(F.col("p") < 0.01, "fail").when(F.col("p") < 0.05, "marginal").otherwise("pass")
    return out.select("group_col", "value_col", F.col("f").alias("w"), "p", verdict.alias("verdict"))


def durbin_watson(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Along the order, without one task for all rows: partitions hand on the value at their edge."""
    v = df.where(F.col(value).isNotNull()).select(*order, F.col(value).cast("double").alias("v"))
    mean = v.agg(F.avg("v")).first()[0] or 0.0
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = v.select(*order, (F.col("v") - mean).alias("e")).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    inside = parted.withColumn("d", F.col("e") - F.lag("e").over(W.partitionBy("__p").orderBy(*order)))
    key = F.struct(*order)
    per = inside.groupBy("__p").agg(F.sum(F.col("d") ** 2).alias("dd"), F.sum(F.col("e") ** 2).alias("ee"), F.min_by("e", key).alias("first"), F.max_by("e", key).alias("last"))
    edge = per.withColumn("edge", F.col("first") - F.lag("last").over(W.orderBy("__p")))  # a row per partition
    dw = F.try_divide(F.sum(F.coalesce("dd", F.lit(0.0)) + F.coalesce(F.col("edge") ** 2, F.lit(0.0))), F.sum("ee"))
    verdict = F.when((F.col("dw") < 1) | (F.col("dw") > 3), "fail").when((F.col("dw") < 1.5) | (F.col("dw") > 2.5), "marginal").otherwise("pass")
    return edge.agg(dw.alias("dw")).withColumn("verdict", verdict)


def breusch_pagan(df: DataFrame, x: str, y: str) -> DataFrame:
    """F form: squared residuals of y on x, regressed on x."""
    rows = df.dropna(subset=[x, y])
    b, a = rows.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    e2 = F.pow(F.col(y) - (F.lit(a) + F.lit(b) * F.col(x)), 2)
    one = rows.select(F.col(x).cast("double").alias("x"), e2.alias("e2")).agg(F.count(F.lit(1)).alias("n"), F.regr_r2("e2", "x").alias("r2")).where("n >= 10")
    out = one.select("n", F.try_divide(F.col("r2"), 1 - F.col("r2")).alias("q")).select("n", (F.col("q") * (F.col("n") - 2)).alias("f"))
    return with_p(out, lambda r: specfun.f_sf(r["f"], 1, r["n"] - 2))


def mardia(df: DataFrame, cols: list[str]) -> DataFrame:
    """Multivariate skewness and kurtosis from third and fourth moments of whitened rows; no n x n matrix."""
    rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    st = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    p, s = len(cols), np.array([st[f"s_{c}"] or 1.0 for c in cols])
    cov = np.array([[st[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / np.outer(s, s)
    val, vec = np.linalg.eigh(np.linalg.pinv(cov))
    white = vec @ np.diag(np.sqrt(np.maximum(val, 0)))
    z = [(F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(float(s[i])) for i, c in enumerate(cols)]
    w = rows.select(*[sum((F.lit(float(white[i, k])) * z[i] for i in range(p)), F.lit(0.0)).alias(f"w{k}") for k in range(p)])
    third = [(a, b, c) for a in range(p) for b in range(a, p) for c in range(b, p)]
    norm4 = F.avg(sum((F.col(f"w{k}") ** 2 for k in range(p)), F.lit(0.0)) ** 2)
    one = w.agg(norm4.alias("kurt"), *[F.avg(F.col(f"w{a}") * F.col(f"w{b}") * F.col(f"w{c}")).alias(f"t{i}") for i, (a, b, c) in enumerate(third)])
    times = lambda t: {1: 1, 2: 3, 3: 6}[len(set(t))]
    sk = sum((times(t) * F.col(f"t{i}") ** 2 for i, t in enumerate(third)), F.lit(0.0))
    return one.select(sk.alias("skew"), "kurt", F.lit(st["n"]).alias("n"))


# --- stability ----------------------------------------------------------------------------------------------------
def segmented(df: DataFrame, order: list[str], parts: int = 4) -> DataFrame:
    """Segment 0 .. parts-1 by row order, n div parts rows each, the last with the remainder."""
    n = df.count()
    at = running(df, [], order, {"__i": F.lit(1)})
    size = max(1, n // parts)
    return at.withColumn("segment", F.least(F.floor((F.col("__i") - 1) / size), F.lit(parts - 1)).cast("int")).drop("__i")


def segment_stats(df: DataFrame, order: list[str], col: str) -> DataFrame:
    return segmented(df, order).groupBy("segment").agg(F.round(F.avg(col), 4).alias("mean"), F.round(F.stddev_samp(col), 4).alias("std"), F.round(F.median(col), 4).alias("median"))


def psi(df: DataFrame, value: str, group: str, bins: int = PSI_BINS, smooth: bool = False) -> DataFrame:
    """Population stability index of group = 1 against group = 0 on equal-width bins of both.

    Shares are floored at 1e-4, or with ``smooth`` every bin gets one more count.
    """
    v = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(group).alias("g"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count_if(F.col("g") == 0).alias("p"), F.count_if(F.col("g") == 1).alias("q"))  # one row
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  one row per bin
    share = (lambda c: (F.col(c) + 1.0) / (total(c) + bins)) if smooth else (lambda c: F.greatest(F.try_divide(F.col(c).cast("double"), total(c)), F.lit(PSI_FLOOR)))
    f = every.select(share("p").alias("p"), share("q").alias("q"))
    return f.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def psi_grade(c):
    return F.when(c < 0.1, "stable").when(c < 0.2, "moderate").otherwise("unstable")


def stability(df: DataFrame, order: list[str], cols: list[str]) -> DataFrame:
    """Per column: PSI and KS of the last against the first segment, spread of the segment means. Strongest drift first."""
    seg = segmented(df, order).persist()
    ends = seg.withColumn("__g", F.when(F.col("segment") == 0, 0).when(F.col("segment") == 3, 1))
    out = None
    for c in cols:
        means = seg.groupBy("segment").agg(F.avg(c).alias("m")).agg(F.try_divide(F.stddev_pop("m"), F.abs(F.avg("m"))).alias("cv"))
        one = psi(ends, c, "__g").crossJoin(ks_statistic(ends, c, "__g")).crossJoin(means).select(F.lit(c).alias("col"), F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), F.round("cv", 4).alias("cv"), "n_a", "n_b")  # one row each
        out = one if out is None else out.unionByName(one)
    tested = with_p(out, lambda r: specfun.ks_2samp_p(r["ks"], r["n_a"], r["n_b"]), "ks_p")
    return tested.select("col", "psi", "ks", "ks_p", "cv", psi_grade(F.col("psi")).alias("grade"))


def category_drift(df: DataFrame, col: str, group: str) -> DataFrame:
    """Chi-square of group 1 against the shares of group 0; a category that is new is floored, not skipped."""
    c = df.where(F.col(group).isin(0, 1) & F.col(col).isNotNull()).groupBy(col).agg(F.count_if(F.col(group) == 0).alias("p"), F.count_if(F.col(group) == 1).alias("q"))
    t = c.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count(F.lit(1)).alias("k"))
    ex = F.greatest(F.col("p") / F.col("tp") * F.col("tq"), F.lit(PSI_FLOOR))
    out = c.crossJoin(F.broadcast(t)).agg(F.sum((F.col("q") - ex) ** 2 / ex).alias("chi2"), F.max("k").alias("k")).where("k between 2 and 50")  # one row
    return with_p(out, lambda r: specfun.chi2_sf(r["chi2"], r["k"] - 1))


# --- splits -------------------------------------------------------------------------------------------------------
def parse_ratios(text: str) -> tuple[float, float, float]:
    parts = [float(x) for x in text.split("/")]
    if len(parts) != 3 or min(parts) <= 0:
        raise ValueError(f"three positive ratios a/b/c are needed, not {text!r}")
    return tuple(x / sum(parts) for x in parts)  # type: ignore[return-value]


def choose_strategy(rows: int, temporal: str | None, target: str | None) -> tuple[str, tuple[float, float, float]]:
    small = parse_ratios("80/10/10") if rows < 1000 else parse_ratios("70/15/15")
    return ("chronological" if temporal else "stratified" if target else "random"), small


def _exact(ratio: float) -> Fraction:
    """The short fraction that the float stands for, as floats put 0.7 of 90,000 below 63,000."""
    short = Fraction(ratio).limit_denominator(1_000_000)
    return short if float(short) == ratio else Fraction(ratio)


def _share(n: Column, part: Fraction) -> Column:
    """floor(n * part) in whole numbers."""
    part = part.limit_denominator(10**15)
    top, bottom = (F.lit(x).cast("decimal(18,0)") for x in (part.numerator, part.denominator))
    return F.call_function("div", n.cast("decimal(20,0)") * top, bottom)


def chronological_split(df: DataFrame, order: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    n = df.count()
    a, b = int(n * _exact(ratios[0])), int(n * (_exact(ratios[0]) + _exact(ratios[1])))
    at = running(df, [], order, {"__i": F.lit(1)})
    return at.withColumn("split", F.when(F.col("__i") <= a, "train").when(F.col("__i") <= b, "val").otherwise("test")).drop("__i")


def hash_order(key: str, seed: int):
    """A number that Spark and DuckDB compute alike from a row's key."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def random_split(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), strata: str | None = None, seed: int = 42) -> DataFrame:
    """Shares of each stratum (or of all) by hash order: exact sizes, no dependence on partitioning."""
    by = [strata] if strata else []
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    at = running(df.withColumn("__h", hash_order(key, seed)), by, ["__h", key], {"__i": F.lit(1)})
    met = at.join(n, by) if by else at.crossJoin(F.broadcast(n))  # one row
    a, b = _share(F.col("__n"), _exact(ratios[0])), _share(F.col("__n"), _exact(ratios[0]) + _exact(ratios[1]))
    return met.withColumn("split", F.when(F.col("__i") <= a, "train").when(F.col("__i") <= b, "val").otherwise("test")).drop("__i", "__n", "__h")


def split_drift(split: DataFrame, cols: list[str]) -> float:
    """Largest smoothed PSI of validation and test against train."""
    worst = 0.0
    for c in cols:
        for other in ("val", "test"):
            g = F.when(F.col("split") == "train", 0).when(F.col("split") == other, 1)
            worst = max(worst, psi(split.withColumn("__g", g), c, "__g", smooth=True).first()[0] or 0.0)
    return worst


def stable_split(df: DataFrame, key: str, cols: list[str], strata: str | None = None, tries: int = 10, limit: float = 0.2) -> tuple[DataFrame, int, float]:
    """The first of ``tries`` seeds whose drift is below the limit, else the best."""
    best = None
    for seed in range(42, 42 + tries):
        s = random_split(df, key, strata=strata, seed=seed)
        d = split_drift(s, cols)
        if best is None or d < best[2]:
            best = (s, seed, d)
        if d < limit:
            break
    return best


FIXTURES["fx_click"] = "SELECT event_id, value, event_type, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 END AS g FROM events"
FIXTURES["fx_typedrift"] = "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND event_id % 2 = 0 THEN 'error' ELSE event_type END AS type_drift, CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' THEN 1 ELSE 0 END AS late FROM events"
_SEG = "select *, least((row_number() over (order by ts, event_id) - 1) // (count(*) over () // 4), 3)::int as segment from fx_drift"
_psi = lambda share_p, share_q: f"with {duck('fx_click')}, s as (select value as v, g from fx_click where g is not null), r as (select min(v) as lo, max(v) as hi from s), h as (select least(floor((v - lo) / (hi - lo) * 10)::int, 9) as bin, count(*) filter (where g = 0) as p, count(*) filter (where g = 1) as q from s, r group by 1), f as (select {share_p} as p, {share_q} as q from h) select round(sum((q - p) * ln(q / p)), 6) as psi from f"
_md5 = lambda c, seed=42: f"('0x' || substr(md5({c}::varchar || ':{seed}'), 1, 8))::bigint"
_split = lambda by="": f"select {{k}}, case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.85) then 'val' else 'test' end as split from (select *, row_number() over ({by} order by {{h}}, {{k}}) as i, count(*) over ({by}) as n from {{t}})"
QUERIES = {
    "shapes": over("events", lambda d: shapes(d, ["value", "user_id"])),
    "histogram": over("lineitem", lambda d: histogram(d, "l_extendedprice", 20)),
    "density": over("events", lambda d: density(d, "value").select("i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))),
    "jarque_bera": over("events", lambda d: r4(jarque_bera(d, ["value", "user_id"]), "jb", "p")),
    "dagostino": over("events", lambda d: r4(r4(dagostino(d, ["value", "user_id"]), "k2", n=2), "p")),
    "anderson_darling": over("events", lambda d: anderson_darling(d, "value").select("n", F.round("a2", 1).alias("a2"), "normal")),
    "shapiro": over("events", lambda d: shapiro(d, "value", "event_id").select("n", (F.col("p") < 0.05).alias("rejected"))),
    "normality_vote": over("events", lambda d: normality_vote(d, "value", "event_id")),
    "best_fit": over("events", lambda d: best_fit(d, "value").limit(1).select("name")),
    "rare_categories": over("part", lambda d: rare_categories(d, "p_name", share=0.02)),
    "monthly": over("orders", lambda d: monthly(d, "o_orderdate")),
    "levene": over("events", lambda d: levene(d, "event_type", "value").select("group_col", "value_col", F.round("w", 4).alias("w"))),
    "durbin_watson": over("fx_drift", lambda d: durbin_watson(d, "value_drift", ["ts", "event_id"]).select(F.round("dw", 4).alias("dw"), "verdict")),
    "breusch_pagan": over("lineitem", lambda d: breusch_pagan(d, "l_quantity", "l_extendedprice").select("n", F.round("f", 3).alias("f"))),
    "mardia": over("lineitem", lambda d: mardia(d, ["l_quantity", "l_tax"]).select(F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"))),
    "segment_stats": over("fx_drift", lambda d: segment_stats(d, ["ts", "event_id"], "value_drift")),
    "psi_floor": over("fx_click", lambda d: psi(d, "value", "g").select(F.round("psi", 6).alias("psi"))),
    "psi_smooth": over("fx_click", lambda d: psi(d, "value", "g", smooth=True).select(F.round("psi", 6).alias("psi"))),
    "stability": over("fx_drift", lambda d: stability(d, ["ts", "event_id"], ["value_drift", "value_stable"]).select("col", "ks", "cv", "grade")),
    "category_drift": over("fx_typedrift", lambda d: category_drift(d, "type_drift", "late").select(F.round("chi2", 2).alias("chi2"), "k")),
    "chronological_split": over("events", lambda d: chronological_split(d, ["ts", "event_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))),
    "random_split": over("orders", lambda d: random_split(d, "o_orderkey").select("o_orderkey", "split")),
    "stratified_split": over("orders", lambda d: random_split(d, "o_orderkey", strata="o_orderstatus").select("o_orderkey", "split")),
    "stable_split": over("customer", lambda d: stable_split(d, "c_custkey", ["c_acctbal"])[0].groupBy("split").agg(F.count(F.lit(1)).alias("n"))),
}
_D = f"with {duck('fx_drift')}"
#: Coefficients of a published rational fit of the complementary error function (relative error below 1.2e-7). Fixed values.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _phi(z: str) -> str:
    """SQL of the normal distribution function."""
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = str(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    tail = f"(0.5 * {t} * exp({poly} - ({z}) * ({z}) / 2))"
    return f"case when ({z}) < 0 then {tail} else 1 - {tail} end"


_ev2 = "(select 'value' as col, value as v from events union all select 'user_id', user_id::double from events)"
ORACLE = {
    "shapes": f"select col, round(s, 4) as skew, case when s < -1 then 'strong_left' when s < -0.5 then 'left' when s <= 0.5 then 'symmetric' when s <= 1 then 'right' else 'strong_right' end as shape, least(greatest(ceil(log2(n) + 1), 10), 50)::int as bins from (select col, count(v) as n, skewness(v) as s from {_ev2} group by col)",
    "histogram": "with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19)::int as bin, count(*)::bigint as n from lineitem, r group by 1",
    "density": "with v as (select value as v, count(*) as c from events where value is not null group by 1), s as (select sum(c) as n, min(v) as lo, max(v) as hi from v), h as (select stddev_samp(value) * power(count(value), -0.2) as h from events), g as (select i::int as i, lo + i * (hi - lo) / 299 as x from s, range(300) t(i)) select i, round(any_value(x), 6) as x, round(sum(exp(-0.5 * ((x - v) / h) ** 2) * c) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) as density from g, v, s, h group by i",
    "jarque_bera": f"select col, round(jb, 4) as jb, round(exp(-jb / 2), 4) as p from (select col, n / 6 * (g1 ** 2 + g2 ** 2 / 4) as jb from (select col, count(v) as n, skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) as g1, kurtosis_pop(v) as g2 from {_ev2} group by col))",
    "dagostino": f"""with m as (select col, count(v)::double as n, skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) as g1, kurtosis_pop(v) + 3 as b2 from {_ev2} group by col having count(v) >= 20),
 s as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 as w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) as x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as sb from m),
 z as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) as a from s),
 i as (select *, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) as inner_v from z), k as (select col, z1 ** 2 + ((1 - 2 / (9 * a) - sign(inner_v) * cbrt(abs(inner_v))) / sqrt(2 / (9 * a))) ** 2 as k2 from i)
 select col, round(k2, 2) as k2, round(exp(-k2 / 2), 4) as p from k""",
    "anderson_darling": f"""with z as (select (value - avg(value) over ()) / stddev_samp(value) over () as z, row_number() over (order by value) as i, count(*) over () as n from events where value is not null),
 a as (select n, (-n - sum((2 * i - 1) * ln(greatest(1e-300, {_phi('z')})) + (2 * n - 2 * i + 1) * ln(greatest(1e-300, {_phi('-z')}))) / n) as a2 from z group by n) select n::bigint as n, round(a2, 1) as a2, a2 < 0.787 / (1 + 4.0 / n - 25.0 / (n * n)) as normal from a""",
    "shapiro": "select least(count(value), 5000)::int as n, true as rejected from events",
    "rare_categories": "select p_name as value, count(*)::bigint as n from part group by 1 having count(*) < 10 or count(*) / (select count(*) from part) < 0.02",
    "monthly": "select strftime(o_orderdate, '%Y-%m') as month, count(*)::bigint as n from orders group by 1",
    "levene": "with m as (select event_type, median(value) as md from events group by 1), x as (select e.event_type as k, abs(value - md) as v from events e join m using (event_type)), g as (select k, count(v) as n, avg(v) as m, var_samp(v) as s2 from x group by k), t as (select sum(n * m) / sum(n) as gm, sum(n) as bn, count(*) as kk from g) select 'event_type' as group_col, 'value' as value_col, round(sum(n * (m - gm) ** 2) / (max(kk) - 1) / (sum((n - 1) * s2) / (max(bn) - max(kk))), 4) as w from g, t",
    "durbin_watson": f"{_D}, e as (select value_drift - avg(value_drift) over () as e, ts, event_id from fx_drift), d as (select e, e - lag(e) over (order by ts, event_id) as d from e) select dw, case when dw < 1 or dw > 3 then 'fail' when dw < 1.5 or dw > 2.5 then 'marginal' else 'pass' end as verdict from (select round(sum(d * d) / sum(e * e), 4) as dw from d)",
    "breusch_pagan": "with c as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem), e as (select (l_extendedprice - (a + b * l_quantity)) ** 2 as e2, l_quantity as x from lineitem, c) select count(*)::bigint as n, round(regr_r2(e2, x) / (1 - regr_r2(e2, x)) * (count(*) - 2), 3) as f from e",
    "mardia": "with z as (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as x, (l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over () as y from lineitem), c as (select covar_samp(x, x) as a, covar_samp(y, y) as b, covar_samp(x, y) as c from z), w as (select x / sqrt(a) as u, (y - c / a * x) / sqrt(b - c * c / a) as v from z, c) select round(avg(u ** 3) ** 2 + 3 * avg(u * u * v) ** 2 + 3 * avg(u * v * v) ** 2 + avg(v ** 3) ** 2, 4) as skew, round(avg((u * u + v * v) ** 2), 4) as kurt from w",
    "segment_stats": f"{_D}, s as ({_SEG}) select segment, round(avg(value_drift), 4) as mean, round(stddev_samp(value_drift), 4) as std, round(median(value_drift), 4) as median from s group by 1",
    "psi_floor": _psi("greatest(p / sum(p) over (), 0.0001)", "greatest(q / sum(q) over (), 0.0001)"),
    "psi_smooth": _psi("(p + 1) / (sum(p) over () + 10)", "(q + 1) / (sum(q) over () + 10)"),
    "stability": f"{_D}, s as ({_SEG}), u as (select segment, 'value_drift' as col, value_drift as v from s union all select segment, 'value_stable', value_stable from s), m as (select col, stddev_pop(m) / abs(avg(m)) as cv from (select col, segment, avg(v) as m from u group by 1, 2) group by 1), g as (select col, v, count(*) filter (where segment = 3) as a, count(*) filter (where segment = 0) as b from u where segment in (0, 3) group by 1, 2), k as (select col, round(max(abs(fa - fb)), 6) as ks from (select col, sum(a) over (partition by col order by v) / sum(a) over (partition by col) as fa, sum(b) over (partition by col order by v) / sum(b) over (partition by col) as fb from g) group by 1) select col, ks, round(cv, 4) as cv, case col when 'value_drift' then 'unstable' else 'stable' end as grade from k join m using (col)",
    "category_drift": f"with {duck('fx_typedrift')}, c as (select type_drift, count(*) filter (where late = 0) as p, count(*) filter (where late = 1) as q from fx_typedrift group by 1), e as (select q, greatest(p / sum(p) over () * sum(q) over (), 0.0001) as ex from c) select round(sum((q - ex) ** 2 / ex), 2) as chi2, count(*)::bigint as k from e",
    "chronological_split": "with o as (select event_id, row_number() over (order by ts, event_id) as i, count(*) over () as n from events) select case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.85) then 'val' else 'test' end as split, count(*)::bigint as n, min(event_id) as lo, max(event_id) as hi from o group by 1",
    "random_split": _split().format(k="o_orderkey", h=_md5("o_orderkey"), t="orders"),
    "stratified_split": _split("partition by o_orderstatus").format(k="o_orderkey", h=_md5("o_orderkey"), t="orders"),
    "stable_split": "select split, count(*)::bigint as n from (" + _split().format(k="c_custkey", h=_md5("c_custkey"), t="customer") + ") group by 1",
}
# votes of the three tests with a SQL form; for Shapiro-Wilk the moment test on the same first rows stands in
ORACLE["normality_vote"] = f"""with f as (select value as v from events where value is not null order by event_id limit {SHAPIRO_ROWS}),
 w as (select n / 6 * (g1 ** 2 + g2 ** 2 / 4) as jb from (select count(v) as n, skewness(v) as g1, kurtosis_pop(v) as g2 from f)),
 t as (select (j.p > 0.05)::int + (d.p > 0.05)::int + a.normal::int + (exp(-w.jb / 2) > 0.05)::int as votes
  from ({ORACLE["jarque_bera"]}) j, ({ORACLE["dagostino"]}) d, ({ORACLE["anderson_darling"]}) a, w where j.col = 'value' and d.col = 'value')
 select 4::bigint as tests, votes::bigint as normal_votes, 2 * votes > 4 as normal from t"""
