"""Queries that run whole plans, snapshots and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import duck, over

PLAN = {
    "drop_columns": [{"column": "y_sparse", "reason": "too_much_missing"}],
    "impute": [
        {"column": "y_mcar", "method": "regression", "group_by": None, "regressors": ["l_quantity"]},
        {"column": "y_mar_cat", "method": "grouped_median", "group_by": ["l_returnflag"], "regressors": None},
        {"column": "flag_missing", "method": "mode", "group_by": None, "regressors": None},
    ],
    "engineer": [
        {"name": "qty_ratio", "operation": "ratio", "source_columns": ["y_mcar", "l_quantity"], "params": {}},
        {"name": "qty_bin", "operation": "bin", "source_columns": ["l_quantity"], "params": {"bins": 4}},
    ],
    "encode": [{"column": "flag_missing", "method": "frequency", "categories": None}],
    "transform": [{"column": "y_mcar", "method": "robust_scale"}, {"column": "l_quantity", "method": "log1p"}],
}


def _run_plan(d):
    from ..plans.runner import fit

    out, _ = fit(d, PLAN, "l_orderkey")
    return out.groupBy("qty_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("log_qty"), F.round(F.avg("qty_ratio"), 4).alias("qty_ratio"), F.round(F.avg("flag_missing"), 6).alias("flag"))


def _make_plan(d):
    from ..plans.runner import plan_for

    plan = plan_for(d.select("l_orderkey", "l_returnflag", "l_quantity", "y_mcar", "y_sparse", "flag_missing"), "l_orderkey")
    return d.sparkSession.createDataFrame([(step, x["column"], x.get("method", "drop")) for step, xs in plan.items() for x in xs], "step string, col string, method string")


def _metrics(d):
    from ..plans.runner import key_metrics

    return key_metrics(d.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def _windows(d):
    from ..streaming.drift import windowed_profile

    return windowed_profile(d, "ts", "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 4).alias("mean"))


def _sessions(d):
    from ..streaming.drift import sessions

    return sessions(d, "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


QUERIES = {
    "run_plan": over("fx_missing", _run_plan),
    "make_plan": over("fx_missing", _make_plan),
    "key_metrics": over("fx_dupes", _metrics),
    "windowed_profile": over("events", _windows),
    "sessions": over("events", _sessions),
}
_F = f"with {duck('fx_missing')}"
ORACLE = {
    "run_plan": f"""{_F}, f as (select regr_slope(y_mcar, l_quantity) as b, regr_intercept(y_mcar, l_quantity) as a, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as q from fx_missing),
 m as (select flag_missing as m from fx_missing where flag_missing is not null group by 1 order by count(*) desc, 1 limit 1), fr as (select coalesce(flag_missing, m) as fl, count(*) / sum(count(*)) over () as p from fx_missing, m group by 1)
 select case when l_quantity <= q[1] then 0 when l_quantity <= q[2] then 1 when l_quantity <= q[3] then 2 else 3 end as qty_bin, count(*)::bigint as n, round(avg(ln(1 + l_quantity)), 6) as log_qty, round(avg(coalesce(y_mcar, a + b * l_quantity) / l_quantity), 4) as qty_ratio, round(avg(p), 6) as flag
 from fx_missing, f, m join fr on fl = coalesce(flag_missing, m) group by 1""",
    "make_plan": "select * from (values ('drop_columns', 'y_sparse', 'drop'), ('impute', 'y_mcar', 'median'), ('impute', 'flag_missing', 'mode'), ('encode', 'l_returnflag', 'onehot'), ('encode', 'flag_missing', 'onehot')) t(step, col, method)",
    "key_metrics": f"with {duck('fx_dupes')}, c as (select round(corr(c_custkey, c_nationkey), 4) as r from fx_dupes union all select round(corr(c_custkey, c_acctbal), 4) from fx_dupes union all select round(corr(c_nationkey, c_acctbal), 4) from fx_dupes) select count(*)::bigint as n_rows, 0::bigint as n_missing, (select count(*) from (select distinct * from fx_dupes))::bigint as n_distinct, (select arg_max(r, abs(r)) from c) as strongest_r from fx_dupes",
    "windowed_profile": "select strftime(ts, '%Y-%m-%d') as day, count(value)::bigint as n, round(avg(value), 4) as mean from events group by 1",
    "sessions": "with g as (select user_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as first from events) select user_id, sum(first)::bigint as sessions, count(*)::bigint as events from g group by 1",
}
