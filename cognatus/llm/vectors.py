"""Vectors fit for cosine comparison, and what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, vec, dim)``, one row per id; vec is an array of floats if it was one, else of doubles.

    Left out: null ids, and vectors that are null, empty, all zero, or hold a null or
    non-finite component. Rows that repeat an id are one vector, the least of them.
    """
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.col(vec_col).cast(kind)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(id_col).isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)
    rows = df.where(F.coalesce(fit, F.lit(False))).groupBy(F.col(id_col).alias("id")).agg(F.min(vec).alias("vec"))
    return rows.withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added up from the first component on, as SQL would."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[0])
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for every caller."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
