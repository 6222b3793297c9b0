"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.names import col


def width(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, of two as frequent the larger; 0 without vectors.
    One pass that counts lengths before it shuffles."""
    sizes = rows.where(col(vector).isNotNull()).groupBy(F.size(col(vector)).alias("n")).count().where("n > 0")
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return top.n if top else 0


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of ``dim`` finite entries, and these as a matrix of doubles."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dim))
    begin = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    has = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(has & (np.diff(begin) == dim))
    if not dim:
        return at[:0], np.zeros((0, 0))
    x = flat[begin[at][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]
