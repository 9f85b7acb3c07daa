"""Small logistic models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(labels: DataFrame, label: str, fold_is_fit, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids of the fitting fold, in hash order: id, label."""
    return (
        labels.filter(fold_is_fit & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(rows)
    )


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def descend(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; deterministic."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that best maps x to y; targets are
    drawn in a little, so that a clean split stays finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, scale = x.mean(), x.std() or 1.0
    z = (x - centre) / scale

    def gradient(w):
        e = sigmoid(w[0] * z + w[1]) - t
        return np.array([(e * z).mean(), e.mean()])

    a, b = descend(gradient, np.zeros(2), 600, 0.05)
    return float(a / scale), float(b - a * centre / scale)
