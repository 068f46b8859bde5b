"""Folds and labels that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """True where crc32 of doc_id as text leaves 0 divided by 5; null doc_ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of rows that may be learned from, one for each doc_id; of differing labels the larger counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    return rows.where(F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve over grouped observations, by Newton's method."""
    scale = float(np.sqrt(np.average((x - np.average(x, weights=total)) ** 2, weights=total))) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta, penalty = np.zeros(2), np.diag([ridge, ridge]) * total.sum() / 100

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((total * np.logaddexp(0, z) - positive * z).sum() + b @ penalty @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (total * p - positive) + penalty @ beta
        step = np.linalg.solve((design.T * (total * p * (1 - p))) @ design + penalty + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])
