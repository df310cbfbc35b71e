"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator of this package counts it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table for each of its files at least, where there are more partitions than that and twice the cores.
FILE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the session's shared folder; only where none is set and all runs in one process (local tests) make one."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabquarry-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which any executor can read again."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name derived from ``name`` that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    ensure_checkpoints(spark)
    top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def size_of(df: DataFrame) -> int:
    """Bytes of a table that is read from files, as its plan tells; of other plans a guess, often far too high."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(df: DataFrame, per: int = FILE_BYTES) -> int:
    """How many files a table made from ``df`` shall have at most. Without native libraries Hadoop starts about six processes
    for each local file that it writes (chmod), and each of them counts the JVM's memory twice for a moment; so a few
    kilobytes shall not go into as many files as there are partitions. Tasks stay at least twice as many as cores."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(-(-size_of(df) // per), 1 << 20))


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Unlike a checkpoint it carries no constraints of the old plan,
    which would pile up in loops. Beyond ``files`` partitions a task writes several of them, one after the other."""
    path = shared_folder(df.sparkSession, "cut")
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
