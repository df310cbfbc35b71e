"""From raw documents to packed sequences: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; between stages the rows are
written as Parquet to a folder that all executors share, so a lost executor costs at most a stage's own work.

Cases, for every stage: a null text counts as empty; rows that repeat whole are rows of their own, of which the
near-duplicate stage keeps one; ties in scores and sizes are broken by hashes of the id, so that reruns agree; very long texts
go through whole; an empty table gives an empty table; further columns, also such whose names clash with those a stage uses
inside, pass through all stages but the last, which returns the columns of ``packing.pack`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquarry.llm import mixing, neardup, packing, pii, quality
from tabquarry.llm.common import files_for, fresh, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score below the threshold. Without labels of both kinds every
    document scores the mean label (0.5 without any). Texts stay as they are."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id (null ids come last). Documents without words, and so
    without shingles, are no duplicates of anything and all stay."""
    return neardup.distinct_documents(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are generalised or removed; no document goes. n_chars follows the new text; null
    texts stay null."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows repeat. Documents without words weigh nothing and are taken by the
    same rule."""
    return mixing.mixed(docs).coalesce(files_for(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, each in its sequence; a null or empty text is the end id alone."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Classifier, links, disclosure and packing have no SQL form. Tests hold each stage's whole rows, and the packed pieces,
#: against plain Python versions; only the classifier's model is taken as fitted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
