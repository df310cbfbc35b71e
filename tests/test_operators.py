"""Queries against their SQL on the smallest tables, and edge cases of the operators."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabquarry import operators
from tabquarry.functions import specfun
from tabquarry.operators import base, drift, impute, neighbours, outliers, prep, profile, quality

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = operators.collect("QUERIES"), operators.collect("ORACLE")
#: A few of each module; the driver compares all of them.
CHECKED = (
    "profile_numeric", "average_rank", "sentinels", "near_duplicates", "exact_duplicates", "mar_numeric", "impute_regression", "impute_knn", "nearest_donor",
    "ks_two_sample", "spearman", "chi_square_yates", "anova", "interaction_score", "outlier_summary", "local_outlier_factor", "dbscan_noise", "mardia",
    "durbin_watson", "psi_floor", "stability", "stratified_split", "engineer_bin", "encode_woe", "encode_binary", "transform_robust_scale", "run_plan", "sessions",
)


def _norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in base.TABLES:
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return con


def test_registry():
    assert not set(ORACLE) - set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = sorted(range(len(df.columns)), key=lambda i: df.columns[i]), sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted([tuple(_norm(r[i]) for i in a) for r in df.collect()], key=str) == sorted([tuple(_norm(r[i]) for i in b) for r in rel.fetchall()], key=str)


def test_empty_and_null_frames(spark):
    empty = spark.createDataFrame([], "k long, x double, s string")
    assert profile.profile_numeric(empty, ["x"]).count() == 0
    assert quality.near_duplicates(empty, "k").count() == 0
    assert drift.psi(empty.withColumn("g", base.F.lit(0)), "x", "g").first()[0] is not None
    nulls = spark.createDataFrame([(1, None, None), (2, None, None), (3, float("nan"), None)], "k long, x double, s string")
    assert {r["col"]: r["n_unique"] for r in profile.column_profile(nulls).collect()}["x"] == 0
    assert sorted(r["col"] for r in profile.zero_variance(nulls).collect()) == ["s", "x"]
    assert [r["col"] for r in quality.constant_columns(nulls).collect()] == []


def test_skew_and_kurtosis_as_pandas(spark):
    x = [1.0, 2.0, 2.0, 3.5, 9.0, 11.0, None, 4.0]
    r = profile.distribution_moments(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    assert r["skew"] == pytest.approx(pd.Series(x).skew(), abs=1e-4) and r["kurt"] == pytest.approx(pd.Series(x).kurtosis(), abs=1e-4)


def test_running_sums_with_hot_values(spark):
    df = spark.createDataFrame([(i, 5.0 if i % 3 else float(i)) for i in range(300)], "k long, x double")
    out = base.average_rank(df, "x", "r").toPandas().sort_values("k")
    assert (out["r"].to_numpy() == pd.Series(out["x"].to_numpy()).rank().to_numpy()).all()


def test_quartile_bins_with_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3, 4, 5, 9)], "x double")
    assert [r["f"] for r in prep.engineer(df, "f", "bin", ["x"]).orderBy("x").collect()] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_imputation_leaves_observed_cells(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 4 == 0 else 2.0 * i + 1) for i in range(60)], "k long, x double, y double")
    for m in ("mean", "median", "regression", "pmm", "knn", "hotdeck", "em", "mice", "softimpute", "gain", "mida", "hivae"):
        out = impute.apply(df, "y", m, impute.Evidence("k", ["x"]))[0].toPandas().sort_values("k")
        assert out["y"].notna().all(), m
        seen = out[out["k"] % 4 != 0]
        assert (seen["y"] == 2 * seen["x"] + 1).all(), m
    assert impute.apply(df, "y", "no_such_method", impute.Evidence("k"))[1] == "fallback_median"


def test_information_of_skewed_columns_and_numeric_targets(spark):
    rng = np.random.default_rng(1)
    n = 3000
    z, e, flat = rng.normal(size=(3, n))
    skewed = np.exp(3 * z)
    skewed[0] = 1e12
    y = 0.8 * z + 0.6 * e
    df = spark.createDataFrame(pd.DataFrame({"skewed": skewed, "flat": flat, "y": y, "label": (z > 0).astype(int), "zeros": np.where(z > 1.9, z, 0.0)}))
    mi = {r["col"]: r["mi"] for r in prep.mutual_information(df, ["skewed", "flat"], "y").collect()}
    assert mi["skewed"] == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.12) and mi["flat"] < 0.01
    mi = {r["col"]: r["mi"] for r in prep.mutual_information(df, ["skewed", "flat", "zeros"], "label").collect()}
    assert mi["skewed"] > 0.5 and mi["zeros"] > 0.01 and mi["flat"] < 0.01
    mi = {r["col"]: r["mi"] for r in prep.mutual_information(df, ["skewed", "flat", "y"]).collect()}
    assert mi["skewed"] > 0.3 and mi["y"] > 0.3 and mi["flat"] < 0.01
    assert prep.select_features(df, ["skewed", "flat"], "y", 1).select("col").collect() == [("flat",)]
    assert prep.select_features(df, ["skewed", "flat", "y"], None, 1).where("col = 'skewed'").count() == 0


def test_knn_with_partly_observed_rows(spark, duck):
    rng = np.random.default_rng(2)
    n = 120
    x = np.round(rng.normal(size=(n, 3)), 3)
    x[rng.random((n, 3)) < 0.4] = np.nan
    y = np.where(np.arange(n) % 4 == 0, np.nan, np.arange(n) * 1.0)
    x[8] = np.nan
    gap = (x[:, None, :] - x[None, :, :]) ** 2
    both = (~np.isnan(gap)).sum(2)
    d = np.where(both > 0, np.round(np.sqrt(np.nansum(gap, 2) * 3 / np.maximum(both, 1)), 9), np.inf)
    rows = [[i, *[None if math.isnan(v) else float(v) for v in (*x[i], y[i])]] for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double").withColumn("s", base.F.format_string("c%03d", base.F.col("y").cast("int")))
    df = df.withColumn("s", base.F.when(base.F.col("y").isNotNull(), base.F.col("s")))
    seen = [j for j in range(n) if not math.isnan(y[j])]
    names = [f"c{int(y[j]):03d}" for j in seen]
    want, text = {}, {}
    for i in range(0, n, 4):
        near = sorted((d[i, j], j) for j in seen if np.isfinite(d[i, j]))[:5]
        want[i] = np.mean([y[j] for _, j in near]) if near else np.nanmean(y)
        text[i] = names[int(np.round(np.mean([seen.index(j) for _, j in near] if near else range(len(seen)))))]
    ev = impute.Evidence("k", ["a", "b", "c"])
    assert {r["k"]: r["y"] for r in impute.knn(df, "y", ev).where("k % 4 = 0").collect()} == pytest.approx(want)
    assert {r["k"]: r["s"] for r in impute.knn_categorical(df, "s", ev).where("k % 4 = 0").collect()} == text
    for name in ("impute_knn_categorical", "impute_hotdeck", "mutual_information"):
        test_against_sql(spark, duck, name)


def test_knn_with_very_many_categories(spark):
    rows = spark.range(10_050).selectExpr("id as k", "cast(id as double) as x", "case when id in (7, 10040) then null else format_string('c%06d', id) end as s")
    out = {r["k"]: r["s"] for r in impute.knn_categorical(rows, "s", impute.Evidence("k", ["x"]), 1).where("k in (7, 10040, 10049)").collect()}
    assert out == {7: "c000006", 10040: "c010039", 10049: "c010049"}


def test_row_agreement_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(70, 2)) * 0.3 - 2, rng.normal(size=(70, 2)) * 0.3 + 2, [[-2.0, 2.0]], [[30.0, 30.0]]])
    n = len(x)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(n, None, 0.0)], "k long, a double, b double")
    whole = np.column_stack([x[:, 0], x[:, 1]])
    q = [np.percentile(c, [25, 75]) for c in (x[:, 0], np.append(x[:, 1], 0.0))]
    iqr = np.any([(c < lo - 1.5 * (hi - lo)) | (c > hi + 1.5 * (hi - lo)) for c, (lo, hi) in zip(whole.T, q, strict=True)], axis=0)
    z = (x - x.mean(0)) / x.std(0)
    med = np.median(x, axis=0)
    modz = (np.abs(0.6745 * (x - med) / np.median(np.abs(x - med), axis=0)) > 3.5).any(1)
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), 9)
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:20] for i in range(n)]
    kd = [d[i, o[-1]] for i, o in enumerate(order)]
    lrd = [1 / (np.mean([max(d[i, j], kd[j]) for j in o]) + 1e-10) for i, o in enumerate(order)]
    lof = np.array([np.mean([lrd[j] for j in o]) / lrd[i] for i, o in enumerate(order)]) > 1.5
    eps = outliers.dbscan_eps(df.where("a is not null"), "k", ["a", "b"]).first()["eps"]
    core = (d <= eps).sum(1) >= 5
    noise = ~((d <= eps) & core[None, :]).any(1)
    got = outliers.row_flags(df, "k", ["a", "b"]).toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(n))
    for name, want in (("iqr", iqr), ("z", (np.abs(z) > 3).any(1)), ("modz", modz), ("lof", lof), ("dbscan", noise)):
        assert got[name].tolist() == want.tolist(), name
    score = outliers.isolation_forest(df, "k", ["a", "b"]).toPandas().sort_values("k")["score"]
    assert got["forest"].tolist() == (score > 0.5).tolist() and got["forest"].iloc[-1] and not got["forest"].all()
    count = {r["k"]: r["methods"] for r in outliers.row_agreement(df, "k", ["a", "b"]).collect()}
    assert count == dict(zip(got["k"], got[list(outliers.METHODS)].sum(axis=1), strict=True))
    assert lof[n - 2] and not iqr[n - 2] and count[n - 2] >= 1  # only multivariate methods see this row


def test_density_against_brute_force_with_copies(spark, monkeypatch):
    """Many copies of some points, blocks of a few points, ties, and no pairs of rows anywhere."""
    monkeypatch.setattr(neighbours, "POINTS", 16)
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.normal(size=(90, 2)), np.repeat(rng.normal(size=(3, 2)), 40, axis=0), rng.integers(0, 6, (60, 2)) / 2, [[9.0, 9.0], [9.0, 9.05]]])
    n, k = len(xy), 5
    df = spark.createDataFrame([(7 * i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "k long, a double, b double")
    z = (xy - xy.mean(0)) / xy.std(0)
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), 9)
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    kd = [d[i, o[-1]] for i, o in enumerate(order)]
    lrd = [1 / (np.mean([max(d[i, j], kd[j]) for j in o]) + 1e-10) for i, o in enumerate(order)]
    got = {r["k"]: r["lof"] for r in outliers.local_outlier_factor(df, "k", ["a", "b"], k).collect()}
    assert len(got) == n and all(abs(got[7 * i] / (np.mean([lrd[j] for j in o]) / lrd[i]) - 1) < 1e-6 for i, o in enumerate(order))
    near = np.sort([sorted(row)[4] for row in d])  # itself counted
    gap = np.abs((near[-1] - near[0]) / (near[-1] - near[0] + 1e-10) * np.arange(n) / (n - 1) - (near - near[0]) / (near[-1] - near[0] + 1e-10))
    assert outliers.dbscan_eps(df, "k", ["a", "b"], 5).first()["eps"] == pytest.approx(max(near[int(np.argmax(np.round(gap / np.sqrt(2), 12)))], 1e-5), abs=1e-9)
    for eps in (0.3, 50.0):
        core = (d <= eps).sum(1) >= 5
        noise = {r["k"]: (r["core"], r["noise"]) for r in outliers.dbscan_noise(df, "k", ["a", "b"], eps).collect()}
        assert noise == {7 * i: (bool(core[i]), bool(not core[i] and not (core & (d[i] <= eps)).any())) for i in range(n)}
        label = np.arange(n)
        for _ in range(n):
            label = np.array([min(label[j] for j in range(n) if core[j] and d[i, j] <= eps) if core[i] else n for i in range(n)])
            if all(label[i] == label[j] for i in range(n) for j in range(n) if core[i] and core[j] and d[i, j] <= eps):
                break
        assert {r["k"]: r["cluster"] for r in outliers.dbscan_clusters(df, "k", ["a", "b"], eps).collect()} == {7 * i: 7 * int(label[i]) for i in range(n) if core[i]}


def test_density_compares_no_more_than_near_blocks(spark, monkeypatch):
    """Rows on a line: the comparisons follow the rows, not their square."""
    monkeypatch.setattr(neighbours, "POINTS", 32)
    df = spark.range(2000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"))
    points = outliers.spread(df, "k", ["a"])
    x = points.table.select("x").toPandas()["x"].map(lambda v: v[0]).to_numpy()[:, None]
    assert len(points.boxes.blocks) > 40
    assert len(points.boxes.visits(x, np.full(len(x), 1e-3))[0]) < 1.2 * len(x)


@pytest.mark.parametrize("n", [90, 180, 1000])
def test_split_sizes_are_exact(spark, n):
    """As floats 0.7 of 90 is below 63."""
    df = spark.range(n).withColumnRenamed("id", "k")
    want = {"train": n * 70 // 100, "val": n * 85 // 100 - n * 70 // 100, "test": n - n * 85 // 100}
    for split in (drift.random_split(df, "k"), drift.chronological_split(df, ["k"])):
        assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == want
    third = {r["split"]: r["count"] for r in drift.random_split(df, "k", drift.parse_ratios("1/1/1")).groupBy("split").count().collect()}
    assert third["train"] == n // 3 and third["val"] == 2 * n // 3 - n // 3


def test_best_fit_of_five_families(spark):
    rng = np.random.default_rng(6)
    n = 1500
    of = lambda v: {r["name"]: r["ks"] for r in drift.best_fit(spark.createDataFrame([(float(t),) for t in v], "x double"), "x").collect()}
    bounded = of(rng.beta(0.5, 0.8, n))
    assert list(bounded)[0] == "beta" and bounded["beta"] < 0.04
    for name, v in (("lognorm", np.exp(0.6 * rng.normal(size=n))), ("gamma", rng.gamma(2.5, 2.0, n))):
        found = of(v - 1.5)
        assert v.min() < 1.5 and set(found) == {"norm", "lognorm", "expon", "gamma", "beta"}
        assert found[name] < 0.05 < found["norm"]


def test_special_functions():
    assert specfun.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert specfun.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert specfun.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    w, p = specfun.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01


def test_fitted_steps_apply_to_other_frames(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0)], "c string, x double")
    other = spark.createDataFrame([("b", 3.0), ("z", None)], "c string, x double")
    out = prep.encode(other, prep.fit_encoder(train, "c", "onehot")).collect()
    assert [(r["c_a"], r["c_b"]) for r in out] == [(0, 1), (0, 0)]
    scaled = prep.transform(other, prep.fit_transform(train, "x", "standard_scale")).collect()
    assert scaled[0]["x"] == pytest.approx(0.0) and scaled[1]["x"] is None


def test_snapshots_and_readers(spark, tmp_path):
    from tabquarry.sources.files import Snapshots, read, validate

    (tmp_path / "in.csv").write_text("a,b,c\n1,x,NA\n2,N/A,2.5\n")
    df = read(spark, str(tmp_path / "in.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double"] and validate(df)["proceed"]
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    snaps.save(df, "load")
    assert snaps.save(df.drop("b").withColumn("a", df["a"].cast("int")), "drop")["removed"] == ["b"]
    assert snaps.entries()[1]["retyped"] == {"a": ["bigint", "int"]} and snaps.latest().columns == ["a", "c"]


def test_temporal_columns_by_whole_name(spark):
    df = spark.createDataFrame([("2024-01-02",) * 3] * 20, "accounts string, Created_At string, date_str string")
    assert [r["col"] for r in profile.temporal_columns(df).collect()] == ["Created_At"]


def test_plan_fitted_on_one_split_fills_another(spark):
    """What a test split is filled with comes from the training split alone."""
    from tabquarry.plans.runner import fit

    train = spark.createDataFrame([(i, float(i % 7), "g" if i % 2 else "h", None if i % 5 == 0 else 3.0 * (i % 7) + 1, "a" if i % 3 else None) for i in range(60)], "k long, x double, g string, y double, s string")
    test = spark.createDataFrame([(1000 + i, float(i % 7), "g" if i % 2 else "h", None if i % 2 else 500.0 + i, None if i % 2 else "z") for i in range(20)], "k long, x double, g string, y double, s string")
    seen = [r["y"] for r in train.collect() if r["y"] is not None]
    for method in ("mean", "median", "grouped_median", "regression", "em", "knn", "hotdeck", "pmm", "missforest", "mice"):
        plan = {"impute": [{"column": "y", "method": method, "regressors": ["x"], "group_by": ["g"]}, {"column": "s", "method": "mode"}], "engineer": [{"name": "m", "operation": "groupby_agg", "source_columns": ["g", "y"]}], "transform": [{"column": "x", "method": "rank"}]}
        _, fitted = fit(train, plan, "k")
        assert not fitted.skipped, method
        rows = {r["k"]: r for r in fitted.apply(test).collect()}
        assert len(rows) == 20 and all(rows[1000 + i]["y"] == 500.0 + i and rows[1000 + i]["s"] == "z" for i in range(0, 20, 2))
        assert all(min(seen) - 1 <= rows[1000 + i]["y"] <= max(seen) + 1 and rows[1000 + i]["s"] == "a" for i in range(1, 20, 2)), method
        assert all(0 < r["x"] <= 1 and r["m"] < 30 for r in rows.values())


def test_session_stream(spark, tmp_path):
    from tabquarry.streaming.drift import sessions

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, "ts", "user_id", "6 hours").writeStream.outputMode("complete").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("sess").collect()) == sorted(sessions(events, "ts", "user_id", "6 hours").collect())


def test_stream_profile(spark, tmp_path):
    from tabquarry.streaming.drift import windowed_profile

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_profile(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("prof").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("prof").agg({"n": "sum"}).first()[0] == events.count()
