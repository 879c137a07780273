"""Shared ground of the vector operators: usable rows, copies, Arrow batches, exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cosines are compared after rounding to this many decimals.
DECIMALS = 9
#: Single-precision products of unit vectors are off by less than this; anything nearer to a limit is recomputed.
SLACK = 2e-6


def usable(vec: Column, dim: int) -> Column:
    """True for a vector of ``dim`` finite numbers that are not all zero; false for null."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(
        vec.isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False)
    )


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Collapse copies: (points, rows). points: rep (smallest id), vec, n. rows: every usable id with its
    vector's 128-bit fingerprint (f1, f2), as in points. Copies of one vector, even a third of all rows, thus cost
    one row in everything that follows. Rows repeated under one id count once."""
    rows = df.where(usable(F.col(vec_col), dim)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")
    ).where("id is not null")
    # + 0.0 makes one zero of both
    marked = rows.select("id", F.transform("vec", lambda x: (x + F.lit(0.0)).cast("float")).alias("vec")).select(
        "id", "vec", F.xxhash64("vec").alias("f1"), F.xxhash64(F.lit("second"), "vec").alias("f2")
    )
    points = marked.groupBy("f1", "f2").agg(
        F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"), F.count(F.lit(1)).alias("n")
    )
    return points, marked.select("id", "f1", "f2")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The (rows, dim) double matrix of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps huge values finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded double-precision cosines of the rows a and b of the unit matrix u."""
    return np.round(np.einsum("ij,ij->i", u[a], u[b]), DECIMALS)


def lists(flat: np.ndarray, dim: int) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, len(flat) * dim + 1, dim, dtype=np.int32)), pa.array(flat.astype(np.float32).ravel())
    )
