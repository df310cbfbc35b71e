"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: the sources, by code point with null last, weigh 1, 2, 3, repeating, and share the total size. A target
stops at ``cap`` times its source's size; the excess is shared again by weight until none is above its cap. That fixed
point is reached directly: with the sources in order of size over weight, the capped ones are a prefix.

Sampling: inside a source every document is expected target / source_size times (at most ``cap``). Along a fixed
order (size stratum, then md5 of the id) the running sum of expected copies plus one random offset is taken, and a
document is emitted once per whole number that its step crosses. The order by size makes the words taken follow the
target closely. The running sum is found in three levels (stratum totals, bucket totals, rows of a bucket), so that
no window holds more than about max(4096, sqrt(n)) rows even if a single source, size or text has most of the rows.

Cases: null or blank text has size 0 and takes 0 words; a null source is a source of its own; repeated rows are
sampled as separate documents; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, fresh, table, word_count

SEED = 17
CAP = 3
ROWS_PER_BUCKET = 4096
CYCLE = 3


def offset(seed: int = SEED) -> float:
    return random.Random(seed).randrange(1, 1 << 20) / (1 << 20)


def prefix_digits(rows: int) -> int:
    """Hex digits of the hash that split each size stratum, so that buckets stay near max(4096, sqrt(rows))."""
    most = max(ROWS_PER_BUCKET, math.isqrt(rows))
    digits = 0
    while rows > most * 16**digits:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, cap: int = CAP, cycle: int = CYCLE) -> DataFrame:
    """(__src, source_size) -> with target. One row per source."""
    by_name = W.orderBy(F.col("__src").asc_nulls_last())
    by_need = W.orderBy(F.col("__need"), F.col("__src").asc_nulls_last())
    everything = W.partitionBy()
    weighed = sizes.withColumn("__w", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn(
        "__need", F.col("source_size") / F.col("__w")
    )
    summed = (
        weighed.withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__before", F.sum(F.col("source_size") * cap).over(by_need) - F.col("source_size") * cap)
        .withColumn("__w_rest", F.sum("__w").over(everything) - F.sum("__w").over(by_need) + F.col("__w"))
    )
    capped = F.col("source_size") * cap * F.col("__w_rest") <= F.col("__w") * (F.col("__total") - F.col("__before"))
    marked = summed.withColumn("__capped", capped)
    left = F.col("__total") - F.sum(F.when(F.col("__capped"), F.col("source_size") * cap).otherwise(0)).over(everything)
    w_left = F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__w"))).over(everything)
    shared = left.cast("double") * F.col("__w") / F.greatest(w_left, F.lit(1))
    return marked.withColumn(
        "target", F.when(F.col("__capped"), (F.col("source_size") * cap).cast("double")).otherwise(shared)
    ).select("__src", "source_size", "target")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    cap: int = CAP,
    seed: int = SEED,
    rows: int | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    Columns of ``docs`` that have one of these names are replaced. ``rows``: the number of rows, if it is known.
    """
    digits = prefix_digits(docs.count() if rows is None else rows)
    own = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "copies"}]
    bits = F.length(F.bin(F.col("__size")))
    based = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.col(f"`{source}`").alias("__src"),
        (word_count() if size is None else size).alias("__size"),
        F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("__h"),
    ).withColumns(
        {
            "__stratum": bits * 16 + F.call_function("shiftright", F.col("__size"), F.greatest(bits - 4, F.lit(0))),
            "__bucket": F.substring("__h", 1, digits),
            "__no_src": F.col("__src").isNull(),
            "__src": F.coalesce("__src", F.lit("")),
        }
    )
    keys = ["__no_src", "__src", "__stratum", "__bucket"]
    buckets = based.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    strata = buckets.groupBy(*keys[:3]).agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words"))
    sizes = (
        strata.groupBy("__no_src", "__src")
        .agg(F.sum("__words").alias("source_size"))
        .select(F.when(~F.col("__no_src"), F.col("__src")).alias("__src"), "source_size")
    )
    targets = source_targets(sizes, cap).select(
        F.col("__src").isNull().alias("__no_src"), F.coalesce("__src", F.lit("")).alias("__src"), "source_size", "target"
    )
    in_source = W.partitionBy("__no_src", "__src").orderBy("__stratum")
    starts = strata.withColumn("__start", F.sum("__n").over(in_source) - F.col("__n")).select(*keys[:3], "__start")
    in_stratum = W.partitionBy(*keys[:3]).orderBy("__bucket")
    placed = (
        buckets.withColumn("__in", F.sum("__n").over(in_stratum) - F.col("__n"))
        .join(starts, keys[:3])
        .join(targets, keys[:2])
        .select(*keys, (F.col("__start") + F.col("__in")).alias("__start"), "source_size", "target")
    )
    at = F.col("__start") + F.row_number().over(W.partitionBy(*keys).orderBy("__h", "__size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = F.lit(offset(seed))
    return (
        based.join(placed, keys)
        .withColumns({"__at": at, "__rate": rate})
        .withColumn("copies", (F.floor(F.col("__at") * F.col("__rate") + u) - F.floor((F.col("__at") - 1) * F.col("__rate") + u)).cast("int"))
        .select(*[F.col(f"`{c}`") for c in own], F.col("__size").alias("size"), "source_size", "target", "copies")
    )


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` alone."""
    size = fresh(docs, "__mix")
    out = mix(docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(size)).select(size, "text", "source", "doc_id"), **params)
    return out.where("copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), "copies"))).select(f"{size}.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op1_mix": op1_mix}
ORACLE = {
    "op1_mix": rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % {CYCLE} + 1 as w from s),
o as (select *, sum(source_size) over () as total, row_number() over (order by source_size / w, source nulls last) as k from w),
c as (select *, sum({CAP} * source_size) over (order by k) - {CAP} * source_size as before, sum(w) over (order by k desc) as w_rest from o),
m as (select *, {CAP} * source_size * w_rest <= w * (total - before) as capped from c),
t as (select source, source_size, case when capped then ({CAP} * source_size)::double
  else (total - sum(case when capped then {CAP} * source_size else 0 end) over ())::double * w::double / greatest(sum(case when capped then 0 else w end) over (), 1)::double end as target from m),
p as (select d.doc_id, d.size, t.source_size, t.target,
  case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate,
  row_number() over (partition by d.source order by length(bin(d.size)) * 16 + (d.size >> greatest(length(bin(d.size)) - 4, 0)), d.h, d.size)::double as k
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (floor(k * rate + {offset()}::double) - floor((k - 1) * rate + {offset()}::double))::bigint * size as taken from p
"""
}
