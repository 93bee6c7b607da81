"""Bounded samples of labelled rows, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a NULL id is in fold 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], where: Column | None = None
) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents of label 0 and of label 1.

    The ids with the smallest hash are taken, so the choice is stable. Only the chosen ids are broadcast:
    the bound of the broadcast is the bound of the sample. Rows without id, label or text are not labelled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    if where is not None:
        known = known.where(where)
    some = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[v]) for v in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))
    return docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if weight is None else weight
    out = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = sigmoid(x @ out)
        slope = x.T @ (weight * (p - y)) + keep * out
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        out = out - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return out
