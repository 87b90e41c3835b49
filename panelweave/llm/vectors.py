"""Helpers of the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vec: Column) -> Column:
    """Is the vector there, without a NULL, NaN or infinite component?"""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def size_of(rows: DataFrame, vec_col: str = "vec") -> tuple[int, int]:
    """(rows, components of the longest vector)"""
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    return n, dim


def sample(rows: DataFrame, n: int, most: int, dim: int, id_col: str = "vec_id", vec_col: str = "vec") -> np.ndarray:
    """About `most` vectors of the `n` rows, chosen by a hash of the id and in a fixed order.

    A hash can choose more where many rows share an id; twice the number is never passed.
    """
    share = min(1 << 30, (most << 30) // max(1, n) + 1)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 30)) < share).select(F.col(vec_col).alias("v"))
    got = matrix(chosen.limit(2 * most).toArrow()["v"], dim)
    return got[np.lexsort(got.T[::-1])] if dim else got


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties by smaller id, in that order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
    else:
        among = np.arange(len(score))
    return among[np.lexsort((ids[among], -score[among]))[:k]]
