"""Summaries against SQL and plain Python, and the deep imputers' accuracy on held-out cells."""

from __future__ import annotations

import math
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from tabquarry.operators import base, impute, relations, summaries

DIR = "/root/testdata/sf0.001"
CHECKED = ("memory_breakdown", "memory_total", "findings", "numeric_strength", "box_data", "box_data_by", "top_categories", "colour_column", "loadings", "missing_matrix", "transform_panels", "total_distortion", "stability_ranking")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in base.TABLES:
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return con


def _norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    df, rel = summaries.QUERIES[name](spark, DIR), duck.sql(summaries.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    rows = lambda got, cols: sorted([tuple(_norm(r[cols.index(n)]) for n in names) for r in got], key=str)
    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), rel.columns)


def test_qq_against_plain(spark):
    values = [3.0, 1.0, 1.0, 7.0, 2.0, 2.0, 2.0, 9.5]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    n, points = len(values), {}
    for i, v in enumerate(sorted(values), 1):
        points.setdefault(v, []).append(i)
    quantile = lambda r: NormalDist().inv_cdf(1 - 0.5 ** (1 / n) if r == 1 else 0.5 ** (1 / n) if r == n else (r - 0.3175) / (n + 0.365))
    want = {v: quantile(sum(r) / len(r)) for v, r in points.items()}
    got = {r["v"]: (r["n"], r["q"]) for r in summaries.qq_points(df, "x").collect()}
    assert {v: c for v, (c, _) in got.items()} == {v: len(r) for v, r in points.items()}
    assert all(abs(got[v][1] - want[v]) < 1e-12 for v in want)
    slope, at = np.polyfit([want[v] for v in sorted(values)], sorted(values), 1)
    line = summaries.qq_line(df, "x").first()
    assert abs(line["slope"] - slope) < 1e-9 and abs(line["intercept"] - at) < 1e-9 and 0 < line["r"] <= 1


def test_box_without_spread_and_by_class(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 5.0), ("a", 99.0), ("b", 1.0), (None, 2.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in summaries.box_data(df, ["x"], "g").collect()}
    assert set(got) == {"a", "b"}
    a = sorted([5.0, 5.0, 5.0, 99.0])
    q1, q3 = np.quantile(a, [0.25, 0.75])
    beyond = [v for v in a if not q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert got["a"]["n_out"] == len(beyond) == 1 and (got["a"]["lo"], got["a"]["hi"]) == (5.0, 5.0)


def test_summaries_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, x double, s string")
    assert summaries.box_data(empty, ["x"]).count() == 0
    assert summaries.qq_points(empty, "x").count() == 0
    assert summaries.top_categories(empty, ["s"]).count() == 0
    assert summaries.panels(empty, empty, "x").count() == 0
    assert {r["n"] for r in summaries.findings(empty).collect()} <= {0}
    assert summaries.memory_total(empty).first()["bytes"] == 0


def test_pairplot_features_of_nearly_equal_pairs(spark):
    """The stronger of two pairs that both round to 1."""
    rows = [(float(i), i + 1e-3 * (i % 2), float((i * 37) % 101), 2.0 * ((i * 37) % 101)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r["col"] for r in summaries.pairplot_features(df, ["a", "b", "c", "d"]).orderBy("place").collect()] == ["c", "d", "a", "b"]


def test_traffic_light_takes_the_worst(spark):
    rows = [(i, i % 2, float((i * 37) % 101) * (10.0 if i % 2 else 1.0), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g long, x double, t double")
    got = {(r["col"], r["test"]): r["status"] for r in summaries.traffic_light(df, ["x", "t"], ["g"], ["k"], [("t", "x")]).collect()}
    assert got["x", "levene"] == "fail" and got["t", "levene"] == "pass"
    assert got["t", "durbin_watson"] == "fail" and {c for c, test in got if test == "breusch_pagan"} == {"x", "t"}


def test_deep_imputers_beat_the_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1500)
    y = 4 + 3 * x + rng.normal(size=1500) * 0.3
    rows = [(i, float(x[i]), float(-2 * x[i] + rng.normal() * 0.2), None if i % 7 == 0 else float(y[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    held = [i for i in range(1500) if i % 7 == 0]
    by_mean = np.sqrt(np.mean([(y[i] - np.mean([y[j] for j in range(1500) if j % 7])) ** 2 for i in held]))
    for method in ("gain", "mida", "hivae"):
        out, used = impute.apply(df, "y", method, impute.Evidence("k"))
        got = {r["k"]: r["y"] for r in out.collect()}
        assert used == method
        assert all(got[i] == rows[i][3] for i in range(1500) if i % 7)  # observed cells stay
        assert np.sqrt(np.mean([(got[i] - y[i]) ** 2 for i in held])) < 0.4 * by_mean, method


def test_deep_imputers_without_a_second_column(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k long, y double")
    out, used = impute.apply(df, "y", "mida", impute.Evidence("k"))
    assert used == "fallback_median" and out.where("y is null").count() == 0


def test_spearman_with_and_without_nulls(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    data = pd.DataFrame({"a": rng.integers(0, 9, 200), "b": rng.integers(0, 9, 200) * 1.5, "c": rng.normal(size=200)})
    data.loc[::7, "c"] = np.nan
    data["d"] = data["a"] * 2 - data["b"]
    got = {(r["a"], r["b"]): r["rho"] for r in relations.spearman(spark.createDataFrame(data), ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6
    for (a, b), rho in got.items():
        both = data[[a, b]].dropna().rank()  # average ranks of the rows complete in both
        assert abs(rho - np.corrcoef(both[a], both[b])[0, 1]) < 1e-9
