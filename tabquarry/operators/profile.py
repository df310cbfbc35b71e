"""Column profiles, type inference, dtype advice, classification, structure and anomaly checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .base import average_rank, clean, duck, kurt, load, long_form, numeric_columns, over, ratio, rounded, skew, string_columns

# --- fixed values: word lists and limits that results depend on ---------------------------------------------------
TARGET_NAMES = ("target", "label", "y", "class", "outcome", "survived", "churn", "default", "fraud")
TEMPORAL_NAMES = ("date", "time", "timestamp", "datetime", "created", "created_at", "updated", "updated_at", "event_date", "order_date", "ts")
SENTINEL_STRINGS = ("N/A", "n/a", "NA", "null", "NULL", "None", "?", ".", "-", "missing", "unknown", "UNKNOWN", "not available", "")
SENTINEL_NUMBERS = (-999, 9999, -1, 99999)
GARBLED = "[Ã©¼¢â€™\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
# ------------------------------------------------------------------------------------------------------------------


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column: n, nulls, distinct, mean, std, min, quartiles, max. One pass in long form."""
    cols = cols or numeric_columns(df)
    cells = long_form(clean(df, cols), cols)
    # two-level distinct count: the values of a column spread over all tasks
    distinct = cells.where("v is not null").groupBy("col", "v").count().groupBy("col").agg(F.count(F.lit(1)).alias("n_unique"))
    stats = cells.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        F.percentile("v", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.5)).alias("q50"), F.percentile("v", F.lit(0.75)).alias("q75"),
        F.max("v").alias("max"),
    )
    return stats.join(distinct, "col", "left").na.fill(0, ["n_unique"])


def null_counts(df: DataFrame) -> DataFrame:
    cells = long_form(clean(df), df.columns, "string")
    return cells.groupBy("col").agg(F.count_if(F.col("v").isNull()).alias("n_null"), F.round(100.0 * F.count_if(F.col("v").isNull()) / F.count(F.lit(1)), 2).alias("pct_null"))


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """n, nulls, distinct values and cardinality ratio of columns of any type."""
    cells = long_form(clean(df), cols or df.columns, "string")
    per = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("col").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("n_null"), F.count("v").alias("n_unique"),
        F.round(F.count("v") / F.sum("c"), 4).alias("cardinality"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of non-null values with their share."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row


def distribution_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = long_form(clean(df, cols), cols)
    return cells.groupBy("col").agg(F.round(skew("v"), 4).alias("skew"), F.round(kurt("v"), 4).alias("kurt"))


def mode_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """Smallest of the most frequent values, from counts that spread over all tasks."""
    counts = long_form(df, cols, "string").where("v is not null").groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("col").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode"))


def mad(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = long_form(clean(df, cols), cols)
    med = cells.groupBy("col").agg(F.median("v").alias("med"))
    return cells.join(F.broadcast(med), "col").groupBy("col").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))  # a row per column


# --- type inference -----------------------------------------------------------------------------------------------
def numeric_as_string(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Share of parseable numbers (2 digits) of string columns, whether it is above 0.8, and the first blockers."""
    cells = long_form(df, cols or string_columns(df), "string").where("v is not null")
    number = F.expr("try_cast(v as double)")
    per = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("ok", number.isNotNull())
    return per.groupBy("col").agg(
        F.round(F.sum(F.when(F.col("ok"), F.col("c")).otherwise(0)) / F.sum("c"), 2).alias("share"), F.min(F.when(~F.col("ok"), F.col("v"))).alias("blocker")
    ).withColumn("numeric", F.col("share") > 0.8)


def date_as_string(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cells = long_form(df, cols or string_columns(df), "string").where("v is not null")
    ok = F.expr("try_cast(v as timestamp)").isNotNull() & F.expr("try_cast(v as double)").isNull()
    return cells.groupBy("col").agg(F.round(F.count_if(ok) / F.count(F.lit(1)), 2).alias("share")).withColumn("date", F.col("share") > 0.8)


def low_cardinality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """String columns fit for a category: under 50 distinct values or under 5%, with the five most frequent."""
    cells = long_form(df, cols or string_columns(df), "string")
    per = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
    sums = per.groupBy("col").agg(F.count("v").alias("n_unique"), F.sum("c").alias("n"))
    first = per.where("v is not null").withColumn("k", F.row_number().over(W.partitionBy("col").orderBy(F.desc("c"), "v"))).where("k <= 5")
    top = first.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), ",").alias("top"))
    small = (F.col("n_unique") < 50) | (F.col("n_unique") / F.col("n") < 0.05)
    return sums.where(small).join(top, "col", "left").select("col", "n_unique", "top")


INT_RANGES = (("byte", 127), ("short", 32767), ("int", 2147483647))


def downcast_advice(df: DataFrame) -> DataFrame:
    """The smallest type that holds each numeric column."""
    cols = numeric_columns(df)
    whole = {f.name for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = long_form(clean(df, cols), cols)
    ends = cells.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v").isNull()).alias("nulls"))
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c, kinds[c])])
    fits = F.lit("bigint")
    for name, top in reversed(INT_RANGES):
        fits = F.when((F.col("lo") >= -top - 1) & (F.col("hi") <= top), F.lit({"byte": "tinyint", "short": "smallint", "int": "int"}[name])).otherwise(fits)
    real = F.when((F.col("nulls") == 0) & (F.greatest(F.abs("lo"), F.abs("hi")) < 3.4e38), F.lit("float")).otherwise("double")
    return ends.select("col", F.element_at(kind, F.col("col")).alias("kind"), F.when(F.col("col").isin(list(whole)), fits).otherwise(real).alias("advice"))


def downcast(df: DataFrame, lossy: bool = False) -> DataFrame:
    """Integers cast to the smallest type; doubles without nulls to float only if ``lossy``."""
    advice = {r["col"]: r for r in downcast_advice(df).collect()}  # a row per column
    return df.withColumns({c: F.col(c).cast(r["advice"]) for c, r in advice.items() if r["advice"] != "float" or lossy})


WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "timestamp": 8, "timestamp_ntz": 8, "date": 4}


def size_estimate(df: DataFrame) -> DataFrame:
    """Bytes of each column: fixed widths, octets of strings."""
    exprs = [F.count(F.lit(1)).alias("__n")] + [F.sum(F.octet_length(c)).alias(c) for c in string_columns(df)]
    one = df.agg(*exprs)
    known = [(f.name, f.dataType.simpleString()) for f in df.schema if f.dataType.simpleString() in WIDTHS or isinstance(f.dataType, T.StringType)]
    cell = [F.struct(F.lit(c).alias("col"), (F.coalesce(F.col(c), F.lit(0)) if k == "string" else F.col("__n") * WIDTHS[k]).cast("long").alias("bytes")) for c, k in known]
    return one.select(F.explode(F.array(*cell)).alias("x")).select("x.*")


def classify(df: DataFrame) -> DataFrame:
    """Analytical type by rule: identifier, binary, categorical, text, datetime, discrete, continuous."""
    per = column_profile(df)
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    k, u, share = F.element_at(kinds, F.col("col")), F.col("n_unique"), F.col("n_unique") / F.greatest(F.col("n") - F.col("n_null"), F.lit(1))
    whole = k.isin("bigint", "int", "smallint", "tinyint")
    kind = (
        F.when(k.startswith("timestamp") | (k == "date"), "datetime").when(u == 2, "binary").when((whole | (k == "string")) & (share == 1) & (u > 1), "identifier")
        .when(k == "string", F.when((u <= 50) | (share < 0.05), "categorical_nominal").otherwise("text")).when(whole & (u <= 20), "categorical_ordinal")
        .when(whole, "discrete").otherwise("continuous")
    )
    return per.select("col", kind.alias("class"), "n_unique")


def target_candidates(df: DataFrame) -> DataFrame:
    """Columns with a target's name, two values, or numbers of up to ten values; by name first, then few values."""
    per = column_profile(df)
    named = F.lower("col").isin(*TARGET_NAMES)
    numbers = F.col("col").isin(numeric_columns(df) or [""])
    return per.where(named | (F.col("n_unique") == 2) | (numbers & F.col("n_unique").between(2, 10))).select("col", named.alias("named"), "n_unique")


def temporal_columns(df: DataFrame) -> DataFrame:
    """Typed date columns, and string columns that mostly parse and whose whole name, but for underscores, is a date's."""
    typed = [f.name for f in df.schema if f.dataType.simpleString().startswith(("timestamp", "date"))]
    hints = {h.replace("_", "") for h in TEMPORAL_NAMES}
    named = [c for c in string_columns(df) if c.lower().strip().replace("_", "") in hints]
    out = df.sparkSession.createDataFrame([(c, 1.0) for c in typed], "col string, share double")
    if named:
        out = out.unionByName(date_as_string(df, named).where("share > 0.8").select("col", "share"))
    return out


# --- structure and anomalies --------------------------------------------------------------------------------------
def garbled(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cells = long_form(df, cols or string_columns(df), "string").where(F.col("v").rlike(GARBLED))
    return cells.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("example"))


def misaligned(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values of raw text columns, meant as numbers, that hold letters."""
    return long_form(df, cols, "string").where(F.col("v").rlike("[A-Za-z]")).groupBy("col").agg(F.count(F.lit(1)).alias("n"))


def repeated_header(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """Of the first rows, those of whose values more than half are column names."""
    names = F.array(*[F.lit(c) for c in df.columns])
    first = df.orderBy(order).limit(rows)
    hits = sum((F.array_contains(names, F.coalesce(F.col(c).cast("string"), F.lit("\0"))).cast("int") for c in df.columns), F.lit(0))
    return first.select(F.col(order).cast("string").alias("row"), hits.alias("hits")).where(F.col("hits") > len(df.columns) / 2)


def sentinels(df: DataFrame) -> DataFrame:
    words = long_form(df, string_columns(df), "string").withColumn("v", F.trim("v")).where(F.col("v").isin(*SENTINEL_STRINGS))
    numbers = long_form(df, numeric_columns(df)).where(F.col("v").isin(*[float(x) for x in SENTINEL_NUMBERS])).select("col", F.col("v").cast("long").cast("string").alias("v"))
    return words.unionByName(numbers).groupBy("col", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def zero_variance(df: DataFrame) -> DataFrame:
    return column_profile(df).where("n_unique <= 1").select("col")


def extreme_skew(df: DataFrame, limit: float = 2.0) -> DataFrame:
    cells = long_form(clean(df), numeric_columns(df))
    out = cells.groupBy("col").agg(F.round(skew("v"), 2).alias("skew"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.median("v"), 4).alias("median"))
    return out.where(F.abs("skew") > limit)


def high_cardinality(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return column_profile(df, string_columns(df)).where(F.col("n_unique") / F.col("n") > limit).select("col", "n_unique")


def ranked(df: DataFrame, col: str, key: list[str]) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("__all"))
    return average_rank(df, col, "__r").crossJoin(F.broadcast(n)).select(*key, F.round(F.col("__r") / F.col("__all"), 6).alias("rank"))  # one row


LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = lambda t, cols: " union all ".join(f"select '{c}' as col, {c}::double as v from {t}" for c in cols)
_TEXT = lambda t, cols: " union all ".join(f"select '{c}' as col, {c}::varchar as v from {t}" for c in cols)
DIRTY_TEXT = ["seg_sentinel", "seg_case", "tags", "name_garbled", "constant_col"]
DIRTY = ["c_custkey", "c_nationkey", "acctbal", *DIRTY_TEXT[:2], "cust_age", "disc_pct", *DIRTY_TEXT[2:]]
TYPED = ["price_str", "date_str", "o_orderpriority", "o_orderstatus"]
MISSING = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax", "y_true", "y_mcar", "y_mar_num", "y_mar_cat", "y_sparse", "flag_missing"]

QUERIES = {
    "profile_numeric": over("lineitem", lambda d: rounded(profile_numeric(d, LINE_NUM), mean=4, std=4, q25=4, q50=4, q75=4)),
    "null_counts": over("fx_missing", null_counts),
    "column_profile": over("fx_dirty", column_profile),
    "value_counts": over("orders", lambda d: value_counts(d, "o_orderpriority")),
    "skew_kurt": over("events", lambda d: distribution_moments(d, ["value", "user_id"])),
    "mode": over("lineitem", lambda d: mode_of(d, ["l_returnflag", "l_linestatus"])),
    "mad": over("lineitem", lambda d: rounded(mad(d, ["l_quantity", "l_extendedprice"]), mad=4)),
    "numeric_as_string": over("fx_typed", lambda d: numeric_as_string(d, TYPED)),
    "date_as_string": over("fx_typed", lambda d: date_as_string(d, TYPED)),
    "low_cardinality": over("fx_typed", lambda d: low_cardinality(d, TYPED)),
    "downcast_advice": over("lineitem", downcast_advice),
    "downcast_apply": over("lineitem", lambda d: downcast(d).agg(F.sum("l_linenumber").alias("lines"), F.sum("l_partkey").alias("parts"), F.round(F.sum("l_tax"), 4).alias("tax"))),
    "size_estimate": over("customer", size_estimate),
    "classify": over("orders", classify),
    "target_candidates": over("fx_target", target_candidates),
    "temporal_columns": over("fx_typed", lambda d: temporal_columns(d.withColumnRenamed("date_str", "order_date"))),
    "garbled": over("fx_dirty", garbled),
    "misaligned": over("fx_typed", lambda d: misaligned(d, ["price_str"])),
    "repeated_header": over("fx_header", lambda d: repeated_header(d, "rid")),
    "sentinels": over("fx_dirty", sentinels),
    "zero_variance": over("fx_dirty", zero_variance),
    "extreme_skew": over("fx_skewed", extreme_skew),
    "high_cardinality": over("fx_dirty", high_cardinality),
    "average_rank": over("lineitem", lambda d: ranked(d, "l_extendedprice", ["l_orderkey", "l_partkey", "l_extendedprice"])),
}
from .base import FIXTURES  # noqa: E402

FIXTURES["fx_header"] = "SELECT c_custkey AS rid, CASE WHEN c_custkey = 2 THEN 'name' ELSE c_name END AS name, CASE WHEN c_custkey = 2 THEN 'segment' ELSE c_mktsegment END AS segment FROM customer"
FIXTURES["fx_skewed"] = "SELECT event_id, value * value * value AS cubed, value FROM events"

_profile = lambda t, cols: f"select col, count(*)::bigint as n, (count(*) - count(v))::bigint as n_null, count(distinct v)::bigint as n_unique, round(count(distinct v) / count(*), 4) as cardinality from ({_TEXT(t, cols)}) group by col"
ORACLE = {
    "profile_numeric": f"""select col, count(*)::bigint as n, (count(*) - count(v))::bigint as n_null, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, min(v) as min,
 round(quantile_cont(v, 0.25), 4) as q25, round(quantile_cont(v, 0.5), 4) as q50, round(quantile_cont(v, 0.75), 4) as q75, max(v) as max, count(distinct v)::bigint as n_unique
 from ({_LONG("lineitem", LINE_NUM)}) group by col""",
    "null_counts": f"with {duck('fx_missing')} select col, (count(*) - count(v))::bigint as n_null, round(100.0 * (count(*) - count(v)) / count(*), 2) as pct_null from ({_TEXT('fx_missing', MISSING)}) group by col",
    "column_profile": f"with {duck('fx_dirty')} {_profile('fx_dirty', DIRTY)}",
    "value_counts": "select o_orderpriority as value, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share from orders where o_orderpriority is not null group by 1",
    "skew_kurt": f"select col, round(skewness(v), 4) as skew, round(kurtosis(v), 4) as kurt from ({_LONG('events', ['value', 'user_id'])}) group by col",
    "mode": f"select col, v as mode from (select col, v, row_number() over (partition by col order by count(*) desc, v) as k from ({_TEXT('lineitem', ['l_returnflag', 'l_linestatus'])}) group by col, v) where k = 1",
    "mad": f"select col, round(mad(v), 4) as mad from ({_LONG('lineitem', ['l_quantity', 'l_extendedprice'])}) group by col",
    "numeric_as_string": f"""with {duck('fx_typed')} select *, share > 0.8 as numeric from (select col, round(count(try_cast(v as double)) / count(*), 2) as share,
 min(v) filter (where try_cast(v as double) is null) as blocker from ({_TEXT('fx_typed', TYPED)}) where v is not null group by col)""",
    "date_as_string": f"""with {duck('fx_typed')} select *, share > 0.8 as date from (select col, round(count(*) filter (where try_cast(v as timestamp) is not null and try_cast(v as double) is null) / count(*), 2) as share
 from ({_TEXT('fx_typed', TYPED)}) where v is not null group by col)""",
    "low_cardinality": f"""with {duck('fx_typed')}, c as (select col, v, count(*) as c, row_number() over (partition by col order by count(*) desc, v) as k from ({_TEXT('fx_typed', TYPED)}) group by col, v)
 select col, count(v)::bigint as n_unique, string_agg(v, ',' order by k) filter (where k <= 5) as top from c group by col having count(v) < 50 or count(v) / sum(c) < 0.05""",
    "downcast_advice": """select * from (values ('l_orderkey', 'bigint', case when (select max(l_orderkey) from lineitem) <= 32767 then 'smallint' else 'int' end),
 ('l_partkey', 'bigint', case when (select max(l_partkey) from lineitem) <= 127 then 'tinyint' when (select max(l_partkey) from lineitem) <= 32767 then 'smallint' else 'int' end),
 ('l_suppkey', 'bigint', case when (select max(l_suppkey) from lineitem) <= 127 then 'tinyint' else 'smallint' end), ('l_linenumber', 'int', 'tinyint'),
 ('l_quantity', 'double', 'float'), ('l_extendedprice', 'double', 'float'), ('l_discount', 'double', 'float'), ('l_tax', 'double', 'float')) t(col, kind, advice)""",
    "downcast_apply": "select sum(l_linenumber)::bigint as lines, sum(l_partkey)::bigint as parts, round(sum(l_tax), 4) as tax from lineitem",
    "size_estimate": """select 'c_custkey' as col, count(*) * 8 as bytes from customer union all select 'c_name', sum(strlen(c_name))::bigint from customer union all select 'c_nationkey', count(*) * 4 from customer
 union all select 'c_acctbal', count(*) * 8 from customer union all select 'c_mktsegment', sum(strlen(c_mktsegment))::bigint from customer""",
    "classify": """select 'o_orderkey' as col, 'identifier' as class, count(distinct o_orderkey) as n_unique from orders union all select 'o_custkey', 'discrete', count(distinct o_custkey) from orders
 union all select 'o_orderstatus', 'categorical_nominal', count(distinct o_orderstatus) from orders union all select 'o_totalprice', 'continuous', count(distinct o_totalprice) from orders
 union all select 'o_orderdate', 'datetime', count(distinct o_orderdate) from orders union all select 'o_orderpriority', 'categorical_nominal', count(distinct o_orderpriority) from orders""",
    "target_candidates": f"with {duck('fx_target')} select 'target' as col, true as named, count(distinct target) as n_unique from fx_target union all select 'leak_bijection', false, count(distinct leak_bijection) from fx_target union all select 'leak_near_const', false, count(distinct leak_near_const) from fx_target",
    "temporal_columns": f"with {duck('fx_typed')} select 'order_date' as col, round(count(try_cast(date_str as timestamp)) / count(*), 2) as share from fx_typed",
    "garbled": f"with {duck('fx_dirty')} select 'name_garbled' as col, count(*)::bigint as n, min(name_garbled) as example from fx_dirty where regexp_matches(name_garbled, '[Ã©¼¢â€™]')",
    "misaligned": f"with {duck('fx_typed')} select 'price_str' as col, count(*)::bigint as n from fx_typed where regexp_matches(price_str, '[A-Za-z]')",
    "repeated_header": "select '2' as row, 2 as hits from customer where c_custkey = 2",
    "sentinels": f"""with {duck('fx_dirty')} select col, v as value, count(*)::bigint as n from (select col, trim(v) as v from ({_TEXT('fx_dirty', DIRTY_TEXT)})
 where trim(v) in ({', '.join(repr(x) for x in SENTINEL_STRINGS)}) union all select col, v::bigint::varchar from ({_LONG('fx_dirty', ['c_custkey', 'c_nationkey', 'acctbal', 'cust_age', 'disc_pct'])})
 where v in (-999, 9999, -1, 99999)) group by 1, 2""",
    "zero_variance": f"with {duck('fx_dirty')} select col from ({_TEXT('fx_dirty', ['c_custkey', 'c_nationkey', 'acctbal', 'cust_age', 'disc_pct', *DIRTY_TEXT])}) group by col having count(distinct v) <= 1",
    "extreme_skew": f"with {duck('fx_skewed')} select * from (select col, round(skewness(v), 2) as skew, round(avg(v), 4) as mean, round(median(v), 4) as median from ({_LONG('fx_skewed', ['event_id', 'cubed', 'value'])}) group by col) where abs(skew) > 2",
    "high_cardinality": f"with {duck('fx_dirty')} select 'name_garbled' as col, count(distinct name_garbled) as n_unique from fx_dirty",
    "average_rank": "select l_orderkey, l_partkey, l_extendedprice, round((rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0) / count(*) over (), 6) as rank from lineitem",
}
