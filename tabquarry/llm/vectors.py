"""Clean vectors with a row number, for the searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def numbered(vectors: DataFrame, key: str, vector: str, kind: str, check) -> DataFrame:
    """(uid, vec_id, dim, vec): vectors as little-endian ``kind`` in binary, without those ``check`` refuses.

    Null and empty vectors, and those that hold a null or a number that is not finite, are left out; a row without an id
    stays, as candidate alone, and comes after all ids in ties. The row number is fixed by a checkpoint, so that repeated
    rows stay apart and reruns agree. ``check`` gives the numbers to keep, of ``kind`` or wider.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, ids, dims, out = [], [], [], []
            for u, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and (y := check(x)) is not None:
                    uids.append(u)
                    ids.append(i)
                    dims.append(len(y))
                    out.append((y if y.itemsize > np.dtype(kind).itemsize else y.astype(kind)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["uid", "vec_id", "dim", "vec"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    return cut(rows.mapInArrow(run, "uid long, vec_id long, dim int, vec binary"))


def matrix(column, kind: str, dim: int) -> np.ndarray:
    """Rows of ``vec`` as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def apart(df: DataFrame) -> DataFrame:
    """The same rows as columns of their own, for a cogroup with a frame of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
