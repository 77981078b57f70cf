"""Weights of the confidence learned from judged detections: logistic regression by Newton steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE, RIDGE = 50, 1e-12, 1e-9


def _score(names: list[str], weights: np.ndarray) -> Column:
    """Intercept and weighted measures."""
    return sum((F.col(c) * float(w) for c, w in zip(names, weights[1:], strict=True)), F.lit(float(weights[0])))


def probability(names: list[str], weights: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-_score(names, weights)))


def fitted(rows: DataFrame, names: list[str], label: str = "label", ridge: float = RIDGE) -> np.ndarray:
    """(intercept, weight of each measure) that make ``label`` (0 or 1) likeliest.

    A step is one aggregate: the gradient and the products of all pairs of measures, weighted, summed where the rows are; with k measures k + 1 and (k + 1)(k + 2) / 2
    numbers come to the driver, no rows. Rows with a null or NaN measure or label are left out. The ridge keeps the weights finite where the labels can be told apart
    exactly. Without rows all weights are 0.
    """
    usable = F.lit(True)
    for c in (*names, label):
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = rows.where(usable).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("_y"))
    each = [F.lit(1.0), *[F.col(c) for c in names]]
    k, weights = len(each), np.zeros(len(each))
    at = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(STEPS):
        told = rows.withColumn("_p", probability(names, weights)).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        sums = told.agg(*[F.sum(x * (F.col("_y") - F.col("_p"))) for x in each], *[F.sum(each[i] * each[j] * F.col("_w")) for i, j in at]).first()
        if sums[0] is None:
            return weights
        gradient, gram = np.array(sums[:k]) - ridge * weights, np.eye(k) * ridge
        for (i, j), v in zip(at, sums[k:], strict=True):
            gram[i, j] += v
            gram[j, i] = gram[i, j]
        step = np.linalg.solve(gram, gradient)
        weights = weights + step
        if np.abs(step).max() <= TOLERANCE * max(1.0, np.abs(weights).max()):
            break
    return weights


def calibrated(rows: DataFrame, names: list[str], weights: np.ndarray, name: str = "calibrated") -> DataFrame:
    """``rows`` with the learned probability, as the confidence is rounded; null where a measure is."""
    return rows.withColumn(name, F.floor(probability(names, weights) * 1000 + 0.5) / 1000)
