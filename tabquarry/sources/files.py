"""Readers by file type, file analysis and validation, versioned Parquet snapshots with a manifest.

Snapshots are Parquet folders v01_<step>, v02_<step>, ... next to a ``manifest`` folder of JSON lines; both go through
Spark's file systems, so they may lie in any store that Spark can write.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: tokens that count as missing when text is read -------------------------------------------------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ------------------------------------------------------------------------------------------------------------------
KINDS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "feather": "feather", "xlsx": "excel", "xls": "excel"}


def kind_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in KINDS:
        raise ValueError(f"unsupported file type {ext!r}")
    return ext


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A real reader for each type. Text is read as strings, missing tokens become null, then types are inferred once."""
    ext = kind_of(path)
    kind = KINDS[ext]
    if kind == "csv":
        reader = spark.read.option("header", True).option("sep", "\t" if ext == "tsv" else ",").option("multiLine", False)
        return reader.schema(schema).csv(path) if schema else typed(na_to_null(reader.csv(path)))
    if kind == "json":
        reader = spark.read.option("multiLine", ext == "json")
        return (reader.schema(schema) if schema else reader).json(path)
    if kind == "feather":
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(path))
    if kind == "excel":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("reading Excel files needs openpyxl") from e
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    return (spark.read.schema(schema) if schema else spark.read).format(kind).load(path)


def na_to_null(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")) for c in text}) if text else df


def typed(df: DataFrame) -> DataFrame:
    """Columns of strings cast to bigint, double, boolean or timestamp where every value allows; one aggregation decides."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    kinds = ("bigint", "double", "boolean", "timestamp")
    # a dot or exponent keeps a number from passing as a whole one
    plain = lambda c, k: F.col(f"`{c}`").rlike(r"^[+-]?\d+$") if k == "bigint" else F.expr(f"try_cast(`{c}` as {k})").isNotNull()
    one = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(text)], *[F.count_if(plain(c, k)).alias(f"{k}{i}") for i, c in enumerate(text) for k in kinds]).first()
    out = {}
    for i, c in enumerate(text):
        fit = next((k for k in kinds if one[f"n{i}"] and one[f"{k}{i}"] == one[f"n{i}"]), None)
        if fit:
            out[c] = F.expr(f"try_cast(`{c}` as {fit})")
    return df.withColumns(out) if out else df


def analyze(spark: SparkSession, path: str) -> DataFrame:
    """extension, bytes, MB, rows, columns, estimate of memory (three times the bytes)."""
    df = read(spark, path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    size = reader.agg(F.sum("length").alias("bytes"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return size.crossJoin(rows).select(  # one row each
        F.lit(kind_of(path)).alias("extension"), "bytes", F.round(F.col("bytes") / 1e6, 2).alias("mb"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.round(3 * F.col("bytes") / 1e6, 2).alias("memory_mb"),
    )


def validate(df: DataFrame) -> dict:
    """Rules instead of a judgement: whether to go on, and what speaks against it."""
    issues = []
    if not df.columns:
        issues.append("no columns")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        issues.append("column names repeat")
    if df.limit(1).count() == 0:
        issues.append("no rows")
    return {"proceed": not issues, "issues": issues}


class Snapshots:
    """Versioned Parquet copies of a frame and what changed from one to the next."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> list[dict]:
        try:
            rows = self.spark.read.schema("version int, entry string").json(f"{self.folder}/manifest").collect()  # a row per version
        except Exception:  # no manifest yet
            return []
        return [json.loads(r["entry"]) for r in sorted(rows, key=lambda r: r["version"])]

    def save(self, df: DataFrame, step: str) -> dict:
        old = self.entries()
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        last = old[-1]["dtypes"] if old else {}
        version = len(old) + 1
        name = f"v{version:02d}_{step}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        entry = {
            "version": version, "name": name, "rows": self.spark.read.parquet(f"{self.folder}/{name}").count(), "dtypes": kinds,
            "added": [c for c in kinds if c not in last] if last else [], "removed": [c for c in last if c not in kinds],
            "retyped": {c: [last[c], kinds[c]] for c in kinds if c in last and last[c] != kinds[c]},
        }
        self.spark.createDataFrame([(version, json.dumps(entry))], "version int, entry string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return entry

    def latest(self) -> DataFrame | None:
        old = self.entries()
        return self.spark.read.parquet(f"{self.folder}/{old[-1]['name']}") if old else None
