"""Parts of the classifiers: sums for least squares and logistic regression over partitions, isotonic steps, sigmoid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import matrix, partition_sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def moments(features: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, means and standard deviations of the vectors in the only column of features."""

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), width)
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    total = partition_sums(features, parts, 2 * width + 1)
    n = max(total[0], 1.0)
    mean = total[1 : width + 1] / n
    return total[0], mean, np.sqrt(np.maximum(total[width + 1 :] / n - mean**2, 1e-12))


def normal_equations(rows: DataFrame, project, width: int, out: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """A'A, A'y, the sum of y and the number of rows of (vector, y), A being project() of the vectors, `out` wide."""

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        a, y = project(matrix(batch.column(0), width)), np.asarray(batch.column(1), dtype=np.float64)
        return np.concatenate(((a.T @ a).ravel(), a.T @ y, a.sum(axis=0), [y.sum(), len(y)]))

    total = partition_sums(rows, parts, out * out + 2 * out + 2)
    n = max(total[-1], 1.0)
    gram, by, ones = total[: out * out].reshape(out, out), total[out * out : out * out + out], total[out * out + out : -2]
    mean = total[-2] / n
    return gram, by - mean * ones, mean, total[-1]


def logistic(rows: DataFrame, width: int, rounds: int = 6, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of y (from 0 to 1) on (vector, y), by Newton's steps, each one sum over the rows."""
    w = np.zeros(width)
    for _ in range(rounds):

        def parts(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            x, y = matrix(batch.column(0), width), np.asarray(batch.column(1), dtype=np.float64)
            p = sigmoid(x @ w)
            return np.concatenate(((x.T @ (x * (p * (1 - p))[:, None])).ravel(), x.T @ (y - p)))

        total = partition_sums(rows, parts, width * width + width)
        step = np.linalg.solve(total[: width * width].reshape(width, width) + ridge * np.eye(width), total[width * width :] - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to the means y of n rows each at ascending x: pooled neighbours."""
    pools: list[list[float]] = []  # sum of y, n, sum of x
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([b * c, c, a * c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])
