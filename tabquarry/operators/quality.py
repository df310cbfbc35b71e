"""Data-quality checks: duplicates, spelling, ranges, near duplicates, date order, derived columns, delimiters."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import FIXTURES, clean, duck, long_form, numeric_columns, over, string_columns
from .profile import _TEXT, DIRTY, DIRTY_TEXT, column_profile

# --- fixed values: name hints and limits that results depend on ---------------------------------------------------
PERCENT_WORDS = ("pct", "percent", "rate", "ratio")
AGE_WORDS = ("age",)
DATE_PAIRS = (
    ("start", "end"), ("begin", "end"), ("created", "updated"), ("created", "closed"), ("open", "close"), ("from", "to"),
    ("departure", "arrival"), ("hire", "termination"), ("birth", "death"), ("issue", "resolve"),
)
# ------------------------------------------------------------------------------------------------------------------


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and their percentage."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.sum(F.col("__c") - 1).alias("n_duplicates"), F.round(100.0 * F.sum(F.col("__c") - 1) / F.sum("__c"), 2).alias("pct"))


def identifier_duplicates(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mixed_case(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Values with several spellings that differ in case or outer blanks only."""
    cells = long_form(df, cols or string_columns(df), "string").where("v is not null").distinct()
    return cells.groupBy("col", F.lower(F.trim("v")).alias("key")).agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")


def outer_whitespace(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cells = long_form(df, cols or string_columns(df), "string")
    return cells.where(F.col("v").rlike(r"^\s|\s$")).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("example"))


def _ends(df: DataFrame, cols: list[str]) -> DataFrame:
    return long_form(clean(df, cols), cols).groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def percentage_range(df: DataFrame) -> DataFrame:
    cols = [c for c in numeric_columns(df) if any(w in c.lower() for w in PERCENT_WORDS)]
    return _ends(df, cols).where("hi > 100 or lo < 0")


def age_range(df: DataFrame) -> DataFrame:
    cols = [c for c in numeric_columns(df) if any(w in c.lower() for w in AGE_WORDS)]
    return _ends(df, cols).where("lo < 0 or hi > 120")


def constant_columns(df: DataFrame) -> DataFrame:
    return column_profile(df).where("n_unique = 1").select("col")


def near_duplicates(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Pairs of rows that agree in at least floor(share * c) of the c other columns, but not in all.

    Rows are joined on each choice of that many columns, so only pairs that agree there are ever formed.
    """
    cols = [c for c in df.columns if c != key]
    least = int(share * len(cols))
    text = df.select(F.col(key), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols])
    found = None
    for part in combinations(cols, least):
        a = text.select(F.col(key).alias("a"), *[F.col(c).alias(c if c in part else f"a_{c}") for c in cols])
        b = text.select(F.col(key).alias("b"), *[F.col(c).alias(c if c in part else f"b_{c}") for c in cols])
        same = sum(((F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int") for c in cols if c not in part), F.lit(least))
        pairs = a.join(b, list(part)).where("a < b").select("a", "b", same.alias("matches"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.where(F.col("matches") < len(cols)).distinct()


def date_order(df: DataFrame) -> DataFrame:
    """Rows in which a date comes after one that its name says it should precede."""
    dates = [f.name for f in df.schema if f.dataType.simpleString().startswith(("timestamp", "date"))]
    pairs = [(a, b) for x, y in DATE_PAIRS for a, b in permutations(dates, 2) if x in a.lower() and y in b.lower()]
    return date_violations(df, pairs)


def date_violations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("early"), F.lit(b).alias("late"), (F.col(a) > F.col(b)).alias("bad")) for a, b in pairs]
    if not cells:
        return df.sparkSession.createDataFrame([], "early string, late string, n long")
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("early", "late").agg(F.count_if("bad").alias("n"))


def derived_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that equal the sum, difference, product or quotient of two others on all rows. A few wide aggregations."""
    tests = []
    for t in cols:
        for a, b in permutations([c for c in cols if c != t], 2):
            x, y, z = F.col(a), F.col(b), F.col(t)
            ops = {"-": x - y, "/": F.try_divide(x.cast("double"), y.cast("double"))} | ({"+": x + y, "*": x * y} if a < b else {})
            for op, e in ops.items():
                near = F.abs(e - z) <= 1e-8 + 1e-6 * F.abs(z)
                tests.append((t, a, op, b, F.bool_and(F.coalesce(near, z.isNull() | e.isNull())) & (F.count(e + z) > 10)))
    out = None
    for k in range(0, len(tests), 24):  # few enough for generated code
        part = tests[k : k + 24]
        one = df.agg(*[e.alias(f"t{i}") for i, (*_, e) in enumerate(part)])
        cells = [F.struct(F.lit(t).alias("col"), F.lit(f"{a} {op} {b}").alias("formula"), F.col(f"t{i}").alias("ok")) for i, (t, a, op, b, _) in enumerate(part)]
        found = one.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("ok").select("col", "formula")
        out = found if out is None else out.unionByName(found)
    return out


def special_characters(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cells = long_form(df, cols or string_columns(df), "string")
    return cells.where(F.col("v").rlike(r"[\x00-\x1f\x7f]")).groupBy("col").agg(F.count(F.lit(1)).alias("n"))


def mixed_delimiters(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cells = long_form(df, cols or string_columns(df), "string")
    counts = cells.groupBy("col").agg(F.count_if(F.contains("v", F.lit(","))).alias("commas"), F.count_if(F.contains("v", F.lit(";"))).alias("semicolons"))
    return counts.where("commas > 0 and semicolons > 0").where(F.least("commas", "semicolons") / F.greatest("commas", "semicolons") > 0.05)


def uniqueness(df: DataFrame) -> DataFrame:
    """Likely identifiers (all values different) and columns of very low uniqueness."""
    share = F.col("n_unique") / F.col("n")
    verdict = F.when((share == 1) & (F.col("n") > 1), "likely_id").when((share < 0.001) & (F.col("n_unique") > 2), "low")
    return column_profile(df).select("col", verdict.alias("verdict")).where("verdict is not null")


FIXTURES["fx_dates"] = "SELECT o_orderkey, o_orderdate AS start_date, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 1) AS end_date FROM orders"
FIXTURES["fx_special"] = "SELECT c_custkey, CASE WHEN c_custkey % 30 = 0 THEN replace(c_name, '#', chr(9)) ELSE c_name END AS name FROM customer"
FIXTURES["fx_formula"] = "SELECT l_quantity, l_tax, l_discount, l_quantity + l_tax AS d_sum, l_quantity - l_discount AS d_diff, l_quantity * l_discount AS d_prod FROM lineitem"
QUERIES = {
    "exact_duplicates": over("fx_dupes", exact_duplicates),
    "identifier_duplicates": over("fx_dupes", lambda d: identifier_duplicates(d, "c_custkey")),
    "mixed_case": over("fx_dirty", mixed_case),
    "outer_whitespace": over("fx_dirty", outer_whitespace),
    "percentage_range": over("fx_dirty", percentage_range),
    "age_range": over("fx_dirty", age_range),
    "constant_columns": over("fx_dirty", constant_columns),
    "near_duplicates": over("fx_near_dupes", lambda d: near_duplicates(d, "rid")),
    "date_order": over("fx_dates", date_order),
    "derived_columns": over("fx_formula", lambda d: derived_columns(d, d.columns)),
    "special_characters": over("fx_special", special_characters),
    "mixed_delimiters": over("fx_dirty", mixed_delimiters),
    "uniqueness": over("lineitem_unique", uniqueness),
}
FIXTURES["lineitem_unique"] = "SELECT event_id, event_type, value FROM events"


def _formulas(cols: list[str]) -> list[str]:
    """SQL of every formula over two columns, as structs with whether it holds."""
    out = []
    for t in cols:
        for a, b in permutations([c for c in cols if c != t], 2):
            ops = {"-": f"{a} - {b}", "/": f"{a} / nullif({b}, 0)"} | ({"+": f"{a} + {b}", "*": f"{a} * {b}"} if a < b else {})
            out += [f"{{'col': '{t}', 'formula': '{a} {op} {b}', 'ok': bool_and(coalesce(abs({e} - {t}) <= 1e-8 + 1e-6 * abs({t}), true)) and count({e}) > 10}}" for op, e in ops.items()]
    return out


ORACLE = {
    "exact_duplicates": f"with {duck('fx_dupes')}, g as (select count(*) as c from fx_dupes group by c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) select sum(c - 1)::bigint as n_duplicates, round(100.0 * sum(c - 1) / sum(c), 2) as pct from g",
    "identifier_duplicates": f"with {duck('fx_dupes')} select c_custkey as id, count(*)::bigint as n from fx_dupes group by 1 having count(*) > 1",
    "mixed_case": f"with {duck('fx_dirty')} select col, lower(trim(v)) as key, count(distinct v)::bigint as spellings from ({_TEXT('fx_dirty', DIRTY_TEXT)}) group by 1, 2 having count(distinct v) > 1",
    "outer_whitespace": f"with {duck('fx_dirty')} select col, count(*)::bigint as n, min(v) as example from ({_TEXT('fx_dirty', DIRTY_TEXT)}) where regexp_matches(v, '^\\s|\\s$') group by 1",
    "percentage_range": f"with {duck('fx_dirty')} select 'disc_pct' as col, min(disc_pct)::double as lo, max(disc_pct)::double as hi from fx_dirty",
    "age_range": f"with {duck('fx_dirty')} select 'cust_age' as col, min(cust_age)::double as lo, max(cust_age)::double as hi from fx_dirty",
    "constant_columns": f"with {duck('fx_dirty')} select col from ({_TEXT('fx_dirty', DIRTY)}) group by col having count(distinct v) = 1",
    "near_duplicates": f"""with {duck('fx_near_dupes')} select * from (select a.rid as a, b.rid as b, (a.c_name = b.c_name)::int + (a.c_nationkey = b.c_nationkey)::int + (a.c_acctbal = b.c_acctbal)::int + (a.c_mktsegment = b.c_mktsegment)::int as matches
 from fx_near_dupes a join fx_near_dupes b on a.rid < b.rid) where matches = 3""",
    "date_order": f"with {duck('fx_dates')} select 'start_date' as early, 'end_date' as late, count(*)::bigint as n from fx_dates where start_date > end_date",
    "derived_columns": f"with {duck('fx_formula')} select x.col, x.formula from (select unnest([{', '.join(_formulas(['l_quantity', 'l_tax', 'l_discount', 'd_sum', 'd_diff', 'd_prod']))}]) as x from fx_formula) where x.ok",
    "special_characters": f"with {duck('fx_special')} select 'name' as col, count(*)::bigint as n from fx_special where contains(name, chr(9))",
    "mixed_delimiters": f"with {duck('fx_dirty')} select 'tags' as col, count(*) filter (where contains(tags, ','))::bigint as commas, count(*) filter (where contains(tags, ';'))::bigint as semicolons from fx_dirty",
    "uniqueness": "select 'event_id' as col, 'likely_id' as verdict union all select 'event_type', 'low' from (select count(distinct event_type) / count(*) as r from events) where r < 0.001",
}
