"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until leaves have the target bytes.

Law ``bytes``: shards get near equal sizes. The unit is the group of equal texts, which stays together; only a group
larger than a shard's target is cut into slices by hash of the id and of the row, so that repeated rows spread too. Dimensions of a group: size, source, language (the
smallest of its rows, spread over a fixed range by checksum) and content hash. A node that still stands for several
shards is split along the dimension of largest extent at the weighted quantile that matches its shards; the quantile is
located exactly by histograms summed in Spark and narrowed pass by pass, for all nodes of a level at once. Groups that
weigh more than a ``HEAVY``-th of a node are laid aside first, so that the rest can even out what they unbalance.

Only one row per node and the few heavy groups reach the driver; every pass moves group rows without texts.

Cases: a null text has size 1 (no bytes, plus 1) and checksum 0, like the empty text, with which it forms one group; null
source or language counts as empty; repeated rows are placed each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, table

SHARDS = 8
HEAVY = 64
GRID = 20
STEP = 12  # bits that one pass over the histograms settles
SLOT_ROWS = 4096
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_text")
WEIGHTS = {"d_size": 1.0, "d_source": 0.75, "d_lang": 0.5, "d_text": 0.25}


def _grid(c: Column) -> Column:
    """A checksum on the grid of 2**GRID places."""
    return F.shiftright(F.crc32(F.coalesce(c, F.lit("")).cast("binary")), 32 - GRID)


def groups_of(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows without texts, groups with weight and dimensions, total size)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            "doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"),
            (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("g1"), F.hash(raw).alias("g2"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    piece = max(1, total // (shards * HEAVY))
    whole = rows.groupBy("g1", "g2", "size").agg(F.count(F.lit(1)).alias("n"))
    # groups above a shard's target are cut; how many slices each gets travels with the group
    slices = whole.withColumn("slices", F.when(F.col("n") * F.col("size") > max(1, total // shards), F.ceil(F.col("n") * F.col("size") / piece)).otherwise(1))
    cut_ones = slices.where("slices > 1").select("g1", "g2", "size", "slices")
    keyed = rows.join(F.broadcast(cut_ones), ["g1", "g2", "size"], "left")  # fewer than ``shards`` groups exceed total / shards
    keyed = keyed.withColumn("slice", F.when(F.col("slices") > 1, F.pmod(F.xxhash64("doc_id", "rid"), F.col("slices"))).otherwise(0)).drop("slices")
    groups = keyed.groupBy("g1", "g2", "size", "slice").agg(
        F.sum("size").alias("w"), F.min(F.coalesce("source", F.lit(""))).alias("source"), F.min(F.coalesce("lang", F.lit(""))).alias("lang")
    )
    top = 1 << GRID
    groups = groups.select(
        "g1", "g2", "size", "slice", "w",
        F.least(F.floor(F.log2(F.col("size").cast("double")) / 40 * top), F.lit(top - 1)).cast("long").alias("d_size"),
        _grid(F.col("source")).alias("d_source"), _grid(F.col("lang")).alias("d_lang"),
        F.pmod("g1", F.lit(top)).alias("d_text"),
        F.pmod(F.xxhash64(F.lit(3), "g1", "g2", "size", "slice"), F.lit(1 << 31)).alias("tie"),
    )
    return keyed, groups, total


def _widest(groups: DataFrame) -> dict[int, str]:
    """Per node (its first shard) the dimension of largest weighted extent."""
    ends = groups.groupBy("a").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    return {r["a"]: max(DIMENSIONS, key=lambda d: r[d] * WEIGHTS[d]) for r in ends}


def _quantiles(light: DataFrame, wanted: dict[int, int]) -> dict[int, int]:
    """Per node the smallest z for which the weights up to it reach ``wanted``; -1 where nothing is wanted."""
    spark = light.sparkSession
    bits, low = GRID + 31, {a: 0 for a in wanted}
    left = {a: w for a, w in wanted.items() if w > 0}
    out = {a: -1 for a in wanted}
    while bits > 0 and left:
        shift = max(0, bits - STEP)
        at = spark.createDataFrame([(a, low[a], w) for a, w in left.items()], "a int, low long, need long")
        inside = light.join(F.broadcast(at), "a").where((F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + (1 << bits)))  # a row per node
        counts = inside.groupBy("a", "need", F.shiftright(F.col("z") - F.col("low"), shift).alias("bin")).agg(F.sum("w").alias("w"))
        summed = counts.withColumn("upto", F.sum("w").over(W.partitionBy("a").orderBy("bin")))
        found = summed.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("w") < F.col("need"))).collect()  # a row per node
        reached = {r["a"]: r for r in found}
        for a in list(left):
            if a not in reached:  # less than wanted: everything goes left
                out[a] = (1 << (GRID + 31)) - 1
                del left[a]
                continue
            low[a] += reached[a]["bin"] << shift
            left[a] -= reached[a]["upto"] - reached[a]["w"]
        bits = shift
    return out | {a: low[a] for a in left}


def _sides(heavy: list, goal: int, light: int, pivot: int) -> tuple[set, int]:
    """(heavy groups that go left, weight the light ones must bring there). By position, or else by weight, so that it adds up."""
    left = {h["id"] for h in heavy if h["z"] <= pivot}
    brought = goal - sum(h["w"] for h in heavy if h["id"] in left)
    if not 0 <= brought <= light:
        left, have = set(), 0
        for h in sorted(heavy, key=lambda h: (-h["w"], h["id"])):
            if have + h["w"] <= goal:
                left.add(h["id"])
                have += h["w"]
        brought = goal - have
    return left, max(0, min(light, brought))


def tree(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` with its shard."""
    spark = groups.sparkSession
    # a: first shard of the node, b: behind its last
    nodes = groups.withColumns({"a": F.lit(0), "b": F.lit(shards)})
    level = shards
    while level > 1:
        nodes = cut(nodes)
        open_ones = nodes.where(F.col("b") - F.col("a") > 1)
        widest = _widest(open_ones)
        if not widest:
            break
        picks = spark.createDataFrame(sorted(widest.items()), "a int, dim string")
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])
        totals = open_ones.groupBy("a", "b").agg(F.sum("w").alias("all"))
        laid = (
            open_ones.join(F.broadcast(picks), "a").join(F.broadcast(totals), ["a", "b"])
            .withColumn("z", value * F.lit(1 << 31) + F.col("tie"))
            .withColumn("heavy", F.col("w") * HEAVY > F.col("all"))
        )
        laid = cut(laid.drop("dim"))
        sums = {r["a"]: r for r in laid.groupBy("a", "b", "all").agg(F.sum(F.when(~F.col("heavy"), F.col("w")).otherwise(0)).alias("light")).collect()}
        goals = {a: r["all"] * (((a + r["b"]) // 2) - a) // (r["b"] - a) for a, r in sums.items()}
        ident = F.concat_ws(":", "g1", "g2", "size", "slice")
        large: dict[int, list] = {a: [] for a in sums}
        for r in laid.where("heavy").select("a", "z", "w", ident.alias("id")).collect():  # fewer than HEAVY per node
            large[r["a"]].append(r)
        light = laid.where("not heavy").select("a", "z", "w")
        # where the plain weighted median lies tells the sides of heavy groups
        share = {a: goals[a] * r["light"] // max(1, r["all"]) for a, r in sums.items()}
        pivots = _quantiles(light, {a: share[a] for a in sums if large[a]})
        lefts: set[str] = set()
        wanted = {}
        for a, r in sums.items():
            side, wanted[a] = _sides(large[a], goals[a], r["light"], pivots.get(a, -1))
            lefts |= {f"{a}|{h}" for h in side}
        borders = _quantiles(light, wanted)
        cuts = spark.createDataFrame([(a, (a + sums[a]["b"]) // 2, z) for a, z in borders.items()], "a int, mid int, border long")
        left_heavy = spark.createDataFrame([(int(x.split("|")[0]), x.split("|")[1]) for x in sorted(lefts)], "a int, id string").withColumn("goes", F.lit(True))
        # a row per node, and fewer than HEAVY per node
        placed = laid.withColumn("id", ident).join(F.broadcast(cuts), "a").join(F.broadcast(left_heavy), ["a", "id"], "left")
        left_side = F.when(F.col("heavy"), F.coalesce("goes", F.lit(False))).otherwise(F.col("z") <= F.col("border"))
        moved = placed.select(*groups.columns, F.when(left_side, F.col("a")).otherwise(F.col("mid")).alias("a"), F.when(left_side, F.col("mid")).otherwise(F.col("b")).alias("b"))
        nodes = moved.unionByName(nodes.where(F.col("b") - F.col("a") <= 1))
        level = (level + 1) // 2
    return nodes.select("g1", "g2", "size", "slice", F.col("a").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    rows, groups, _ = groups_of(docs, shards)
    placed = rows.join(tree(groups, shards), ["g1", "g2", "size", "slice"]).select("doc_id", "rid", "size", "text_crc32", "shard")
    n = rows.count()
    placed = placed.withColumn("__b", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(max(16, n // SLOT_ROWS))))
    counts = placed.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(W.partitionBy("shard").orderBy("__b")) - F.col("__n")).drop("__n")
    row = F.row_number().over(W.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32", "size", "rid")) - 1
    return placed.join(starts, ["shard", "__b"]).select("doc_id", "size", "text_crc32", "shard", (F.col("__start") + row).alias("slot"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_shard": op9_shard}
ORACLE: dict[str, str] = {}
