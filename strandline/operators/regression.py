"""Regressions over groups of any size: Spark reduces the rows to moments, only the moments are solved.

The state that travels through the driver is one small row per group (per horizon or per fold), whatever the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import sigmoid
from strandline.operators.learners import log_odds


# Coefficient tables are broadcast up to this many groups (a few coefficients each), joined by key beyond it.
MAX_BROADCAST_GROUPS = 50_000


def _products(terms: list, weight) -> list:
    return [F.sum(weight * a * b).alias(f"h{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j <= i]


def _matrix(pdf: pd.DataFrame, size: int) -> np.ndarray:
    out = np.empty((len(pdf), size, size))
    for i in range(size):
        for j in range(i + 1):
            out[:, i, j] = out[:, j, i] = pdf[f"h{i}_{j}"]
    return out


def grouped_ridge(df: DataFrame, keys: list[str], xs: list[str], y: str, w: str, lam_per_row: float) -> DataFrame:
    """`keys` + n + coefficient array (intercept last) of a weighted ridge, lambda = lam_per_row * n."""
    k, terms, weight = len(xs), [F.col(x) for x in xs] + [F.lit(1.0)], F.col(w)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *_products(terms, weight),
                                 *[F.sum(weight * t * F.col(y)).alias(f"c{i}") for i, t in enumerate(terms)])
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys]

    def solve(batches):
        for pdf in batches:
            penalty = np.diag([1.0] * k + [0.0]) * (lam_per_row * pdf["n"].to_numpy(float))[:, None, None]
            rhs = pdf[[f"c{i}" for i in range(k + 1)]].to_numpy(float)
            beta = np.linalg.solve(_matrix(pdf, k + 1) + penalty, rhs[..., None])[..., 0]
            yield pdf[[*keys, "n"]].assign(coef=list(beta))

    return sums.mapInPandas(solve, ", ".join([*key_types, "n long", "coef array<double>"]))


def grouped_logistic(df: DataFrame, keys: list[str], xs: list[str], y: str, w: str, lam_per_row: float = 0.0,
                     lam: float = 0.0, steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """`keys` + n + coefficient array (intercept last) of a weighted L2 logistic regression, lambda = lam + lam_per_row*n.

    Each Newton step is one aggregation over the rows with the current coefficients joined in by key."""
    spark, k = df.sparkSession, len(xs)
    weight, terms = F.col(w), [F.col(x) for x in xs] + [F.lit(1.0)]
    start = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(weight * F.col(y)) / F.sum(weight)).alias("rate"))
    state = start.toPandas()
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in start.schema if f.name in keys]
                       + ["n long", "coef array<double>"])
    if state.empty:
        return spark.createDataFrame([], schema)
    beta = np.zeros((len(state), k + 1))
    beta[:, k] = [log_odds(r) for r in state["rate"]]
    penalty = np.append(np.ones(k), 0.0) * (lam + lam_per_row * state["n"].to_numpy(float))[:, None]
    for _ in range(steps):
        current = spark.createDataFrame([(*row, [float(v) for v in b]) for row, b in
                                         zip(state[keys].itertuples(index=False, name=None), beta)],
                                        schema.replace("n long, ", ""))
        z = sum((F.col("coef")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
        hinted = F.broadcast(current) if len(state) <= MAX_BROADCAST_GROUPS else current
        scored = df.join(hinted, keys).withColumn("_p", sigmoid(z))
        curvature = F.greatest(F.lit(1e-6), F.col("_p") * (1 - F.col("_p"))) * weight
        sums = (scored.groupBy(*keys).agg(*_products(terms, curvature),
                                          *[F.sum((F.col("_p") - F.col(y)) * weight * t).alias(f"g{i}")
                                            for i, t in enumerate(terms)]).toPandas())
        sums = state[keys].merge(sums, on=keys, how="left")
        gradient = sums[[f"g{i}" for i in range(k + 1)]].to_numpy(float) + penalty * beta
        hessian = _matrix(sums, k + 1) + penalty[:, :, None] * np.eye(k + 1)
        move = np.linalg.solve(hessian, gradient[..., None])[..., 0]
        beta = beta - move
        if np.abs(move).max() < tolerance:
            break
    return spark.createDataFrame([(*row, int(n), [float(v) for v in b]) for row, n, b in
                                  zip(state[keys].itertuples(index=False, name=None), state["n"], beta)], schema)
