"""Plans: a rule-based planner, and a runner that fits a plan on one split and applies it to any.

A plan is a dict of ``drop_columns``, ``impute``, ``engineer``, ``encode`` and ``transform``; steps run in that order.
Unknown columns and operations are recorded as skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impute, prep, profile, relations
from ..operators.base import cut, numeric_columns

ORDER = ("drop_columns", "impute", "engineer", "encode", "transform")
#: Further named steps, (df) -> df, that run behind the plan's own.
EXTENSIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


@dataclass
class Fitted:
    """Steps as closures over fitted parameters; ``apply`` replays them on any frame with the input's columns."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step(df)
        return df


def fit(df: DataFrame, plan: dict, key: str) -> tuple[DataFrame, Fitted]:
    """(the frame after all steps, what was fitted)."""
    out = Fitted()

    def add(name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        nonlocal df
        df = step(df)
        out.steps.append((name, step))

    gone = [x["column"] for x in plan.get("drop_columns", ())]
    add("drop", lambda d: d.drop(*gone))
    for x in plan.get("impute", ()):
        col = x["column"]
        if col not in df.columns:
            out.skipped.append(f"impute {col}")
            continue
        ev = impute.Evidence(key, x.get("regressors") or [], (x.get("group_by") or [None])[0])
        fill, used = impute.fit(df, col, x["method"], ev)
        if used != x["method"]:
            out.skipped.append(f"impute {col} {x['method']}: {used}")
        add(f"impute {col} {used}", fill)
    for x in plan.get("engineer", ()):
        if not set(x["source_columns"]) <= set(df.columns):
            out.skipped.append(f"engineer {x['name']}")
            continue
        params = dict(x.get("params") or {})
        if x["operation"] == "bin":
            params["edges"] = prep.quantile_edges(df, x["source_columns"][0], int(params.get("bins", 4)))
        elif x["operation"] in ("groupby_agg", "count"):
            params["table"] = cut(prep.group_table(df, x["operation"], x["source_columns"], params))
        try:
            add(f"engineer {x['name']}", lambda d, x=x, p=params: prep.engineer(d, x["name"], x["operation"], x["source_columns"], p))
        except ValueError as e:
            out.skipped.append(str(e))
    for kind, fitter, use in (("encode", prep.fit_encoder, prep.encode), ("transform", prep.fit_transform, prep.transform)):
        for x in plan.get(kind, ()):
            if x["column"] not in df.columns:
                out.skipped.append(f"{kind} {x['column']}")
                continue
            try:
                extra = {"order": x.get("categories"), "target": x.get("target")} if kind == "encode" else {}
                step = fitter(df, x["column"], x["method"], **extra)
            except ValueError as e:
                out.skipped.append(str(e))
                continue
            add(f"{kind} {x['column']} {x['method']}", lambda d, s=step, u=use: u(d, s))
    for name in plan.get("extensions", ()):
        if name in EXTENSIONS:
            add(name, EXTENSIONS[name])
        else:
            out.skipped.append(name)
    return df, out


def plan_for(df: DataFrame, key: str, target: str | None = None) -> dict:
    """A plan by rule from the profile: drop sparse columns, impute, encode categories, scale skewed numbers."""
    summary = {r["col"]: r for r in impute.missing_summary(df).collect()}  # a row per column
    classes = {r["col"]: r["class"] for r in profile.classify(df).collect()}
    skews = {r["col"]: r["skew"] for r in profile.distribution_moments(df, numeric_columns(df)).collect()}
    plan: dict = {k: [] for k in ORDER}
    for c in df.columns:
        if c in (key, target):
            continue
        if summary[c]["verdict"] == "drop":
            plan["drop_columns"].append({"column": c, "reason": "too_much_missing"})
            continue
        if summary[c]["n_null"]:
            plan["impute"].append({"column": c, "method": "median" if c in numeric_columns(df) else "mode", "group_by": None, "regressors": None})
        if classes[c] == "categorical_nominal":
            plan["encode"].append({"column": c, "method": "onehot", "categories": None})
        elif classes[c] in ("continuous", "discrete") and abs(skews.get(c) or 0.0) > 1:
            plan["transform"].append({"column": c, "method": "yeojohnson"})
    return plan


def key_metrics(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row that sums a table up: size, missing cells, duplicates, strongest pair, balance of the target."""
    cols = numeric_columns(df)
    nulls = df.agg(F.count(F.lit(1)).alias("n_rows"), sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("n_missing"))
    out = nulls.crossJoin(df.distinct().agg(F.count(F.lit(1)).alias("n_distinct")))  # one row each
    if len(cols) > 1:
        out = out.crossJoin(relations.top_pairs(df, cols, 1).select(F.col("r").alias("strongest_r")))
    if target:
        out = out.crossJoin(relations.class_balance(df, target).select("balance"))
    return out
