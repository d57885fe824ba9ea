"""Vector columns: which rows hold a usable vector, and batches of them as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    return F.coalesce(F.expr(
        f"size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
        f"AND exists({vector}, x -> x <> 0)"), F.lit(False))


def numbered(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(row, vec_id, vector as doubles); `row` tells rows apart, whatever their ids. Stage before use: it numbers rows as
    they are read."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
                     F.col(vector).cast("array<double>").alias("vector"))


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def rotation(dimension: int, seed: int) -> np.ndarray:
    """Random orthonormal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))
