"""Quality classifier: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

Every text gives a vector of document statistics (shares of character classes, word lengths, repetition). Standardised,
it goes through ``FEATURES`` random cosines, which approximate a Gaussian kernel; a ridge regression on them scores the
text. The normal equations are summed inside each partition and fold, so that only fixed-size sums reach the driver.
Scores of documents left out of a fold's fit give an isotonic map from raw score to probability of label 1.

Fit on at most ``SAMPLE_ROWS`` labelled documents (the smallest hashes of doc_id, so the choice is stable); scoring
covers every document and the whole text. Ids, source, language and labels never enter a score.

Cases: null text counts as empty; an empty text is scored by its (zero) statistics; several labels of one document are
averaged; null labels are ignored; without labels of both kinds every score is the mean label (0.5 without any);
repeated rows are scored each; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

SAMPLE_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-2
FOLDS = 4
THRESHOLD = 0.3
SEED = 5
SUM_TASKS = 8

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~_=+<>\\/",
    "bracket": b"()[]{}\"'`-",
    "control": bytes(range(0, 9)) + bytes(range(14, 32)) + b"\x7f",
    "high": bytes(range(128, 256)),
}
_MAP = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _MAP[list(_chars), _i] = 1.0
N_STATS = len(_CLASSES) + 10


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text. All are shares or logarithms, so a long text does not outweigh a short one."""
    out = np.zeros(N_STATS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    k = len(_CLASSES)
    out[:k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MAP / len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    lengths = np.fromiter(map(len, words), np.float64, n)
    out[k] = np.log1p(n)
    out[k + 1], out[k + 2] = np.log1p(lengths.mean()), np.log1p(lengths.std())
    out[k + 3] = len(set(words)) / n**0.8
    out[k + 4] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[k + 5] = (lengths == 1).mean()
    out[k + 6] = np.log1p(lengths.max())
    out[k + 7] = sum(map(bytes.isupper, words)) / n
    lines = raw.split(b"\n")
    out[k + 8] = 1 - len(set(lines)) / len(lines)
    out[k + 9] = sum(map(bytes.istitle, words)) / n
    return out


def cosines(x: np.ndarray, seed: int = SEED, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(x.shape[1], features)) / np.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * np.pi, features)
    return np.hstack([np.sqrt(2 / features) * np.cos(x @ w + b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (mean x, value) of each block, to be interpolated."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a2, b2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    """What scoring needs; a few tens of kilobytes whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        raw = cosines((stats - self.mean) / self.scale) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y, fold) of at most ``rows`` labelled documents outside the held-out fifth."""
    key = F.crc32(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (key % 5 != 0))
        .groupBy("doc_id")
        .agg(F.when(F.avg(label) >= 0.5, 1.0).otherwise(0.0).alias("y"))
        .withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
        .orderBy("h", "doc_id")
        .limit(rows)
        .select("doc_id", "y", F.pmod("h", F.lit(FOLDS)).alias("fold"))
    )
    # at most ``rows`` rows of 20 bytes, by the limit above
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", "fold")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "fold"])

    sample = cut(training_rows(docs, labels, label, rows).mapInArrow(measure, "x array<double>, y double, fold long").repartition(SUM_TASKS))
    held = sample.toPandas()  # bounded by ``rows``
    y, fold = held["y"].to_numpy(), held["fold"].to_numpy()
    if not len(held) or y.min() == y.max():
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, np.zeros(1), np.array([y.mean() if len(y) else 0.5]))
    x = np.array(held["x"].tolist())
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    m = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = {f: (np.zeros((m, m)), np.zeros(m)) for f in range(FOLDS)}
        for b in batches:
            z = cosines((np.array(b.column(0).to_pylist()) - mean) / scale)
            t, f = b.column(1).to_numpy(), b.column(2).to_numpy()
            for k, (g, h) in a.items():
                g += z[f == k].T @ z[f == k]
                h += z[f == k].T @ t[f == k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(a), pa.int64()), pa.array([g.tobytes() for g, _ in a.values()], pa.binary()), pa.array([h.tobytes() for _, h in a.values()], pa.binary())], ["fold", "g", "h"]
        )

    gram, side = np.zeros((FOLDS, m, m)), np.zeros((FOLDS, m))
    for r in sample.mapInArrow(sums, "fold long, g binary, h binary").collect():  # SUM_TASKS x FOLDS fixed-size sums
        gram[r["fold"]] += np.frombuffer(r["g"]).reshape(m, m)
        side[r["fold"]] += np.frombuffer(r["h"])
    z, raw = cosines((x - mean) / scale), np.zeros(len(x))
    solve = lambda g, h: np.linalg.solve(g + RIDGE * np.eye(m), h)
    for k in range(FOLDS):
        raw[fold == k] = z[fold == k] @ solve(gram.sum(0) - gram[k], side.sum(0) - side[k])
    return Model(mean, scale, solve(gram.sum(0), side.sum(0)), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the score of its column text."""
    rest = fresh(docs, "__row")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                stats = np.array([statistics(t) for t in part.column(0).to_pylist()]).reshape(-1, N_STATS)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(stats)), part.column(1)], [into, rest])

    whole = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(rest))
    schema = f"`{into}` double, `{rest}` {whole.schema[rest].dataType.simpleString()}"
    return whole.mapInArrow(run, schema).select(f"{rest}.*", into)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    texts = docs.select("text", F.col("doc_id"))
    return score_ids(texts, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def score_ids(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score alone: the text does not come back from Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                stats = np.array([statistics(t) for t in part.column(0).to_pylist()]).reshape(-1, N_STATS)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(shared.value.score(stats))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, score double")


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
