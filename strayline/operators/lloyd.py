"""KMeans from given centers: every step is one pass for any number of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.operators.moments import matrix_of, total


def _rows(df: DataFrame, vector: str) -> DataFrame:
    rows = df.select(F.col(vector).cast("array<double>").alias("x"))
    return rows.filter("x IS NOT NULL AND NOT exists(x, e -> e IS NULL OR isnan(e))")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center of each row, the lowest on ties, and the squared distance."""
    squares = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
    own = squares.argmin(axis=1)
    return own, squares[np.arange(len(x)), own]


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Rows and sum of vectors of each cluster, ``[k, 1 + d]``."""
    out = np.zeros((k, 1 + x.shape[1]))
    out[:, 0] = np.bincount(own, minlength=k)
    for i in range(x.shape[1]):
        out[:, 1 + i] = np.bincount(own, weights=x[:, i], minlength=k)
    return out


@dataclass
class Clusters:
    """Centers after some steps, and the rows and cost of the step before."""

    centers: np.ndarray
    sizes: np.ndarray
    cost: float


def lloyd_steps(df: DataFrame, vector: str, starts: Mapping[object, Sequence[Sequence[float]]], steps: int) -> list[dict]:
    """After each step, ``Clusters`` of every model in ``starts``.

    A step assigns each row to its nearest center and moves centers to the means of their
    rows. All models are advanced in the same pass; tasks add up sizes and sums, and only
    those reach the driver. A cluster without rows keeps its center. Rows with an
    unknown element take no part.
    """
    now = {name: np.asarray(c, dtype=float) for name, c in starts.items()}
    d = len(next(iter(now.values()))[0])
    rows, out = _rows(df, vector), []
    bounds = np.cumsum([0, *[len(c) * (1 + d) + 1 for c in now.values()]])
    for _ in range(steps):
        held = list(now.values())

        def partial(batch: pa.RecordBatch, held=held) -> np.ndarray:
            x = matrix_of(batch.column("x"), d)
            found = []
            for centers in held:
                own, squares = _nearest(x, centers)
                found += [_sums(x, own, len(centers)).ravel(), [squares.sum()]]
            return np.concatenate(found)

        sums = total(rows, int(bounds[-1]), partial)
        done = {}
        for (name, centers), a, b in zip(now.items(), bounds, bounds[1:]):
            own = sums[a : b - 1].reshape(-1, 1 + d)
            some = own[:, 0] > 0
            moved = centers.copy()
            moved[some] = own[some, 1:] / own[some, :1]
            done[name] = Clusters(moved, own[:, 0].astype(np.int64), float(sums[b - 1]))
        now = {name: c.centers for name, c in done.items()}
        out.append(done)
    return out


def model_scores(df: DataFrame, vector: str, models: Mapping[object, np.ndarray]) -> dict[object, tuple[float, float]]:
    """Mean silhouette by squared distances, and cost, of every model, in two passes.

    The mean squared distance of a row from a cluster follows from the cluster's size,
    sum and sum of squares, so no pair of rows is compared. A row that is alone in its
    cluster has the silhouette 0.
    """
    rows = _rows(df, vector)
    held = [np.asarray(c, dtype=float) for c in models.values()]
    d = held[0].shape[1]
    bounds = np.cumsum([0, *[len(c) * (2 + d) + 1 for c in held]])

    def gather(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix_of(batch.column("x"), d)
        norms, found = (x * x).sum(axis=1), []
        for centers in held:
            own, squares = _nearest(x, centers)
            found += [_sums(x, own, len(centers)).ravel(), np.bincount(own, weights=norms, minlength=len(centers)), [squares.sum()]]
        return np.concatenate(found)

    sums = total(rows, int(bounds[-1]), gather)
    known = []
    for centers, a, b in zip(held, bounds, bounds[1:]):
        k = len(centers)
        own = sums[a : a + k * (1 + d)].reshape(k, 1 + d)
        known.append((own[:, 0], own[:, 1:], sums[a + k * (1 + d) : b - 1], float(sums[b - 1])))

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix_of(batch.column("x"), d)
        norms, found = (x * x).sum(axis=1), []
        for centers, (n, sum_, squares, _) in zip(held, known):
            own, _ = _nearest(x, centers)
            some = np.maximum(n, 1)
            away = norms[:, None] + (squares / some)[None, :] - 2.0 * x @ (sum_ / some[:, None]).T
            at = np.arange(len(x))
            inside = away[at, own] * n[own] / np.maximum(n[own] - 1, 1)
            away[at, own] = np.inf
            away[:, n == 0] = np.inf
            outside = away.min(axis=1) if len(n) > 1 else np.full(len(x), np.inf)
            fits = (n[own] > 1) & np.isfinite(outside) & (np.maximum(inside, outside) > 0)
            scores = np.where(fits, (outside - inside) / np.where(fits, np.maximum(inside, outside), 1.0), 0.0)
            found.append(scores.sum())
        return np.array([*found, len(x)])

    *scores, n = total(rows, len(held) + 1, measure)
    return {name: (float(s / n) if n else 0.0, cost) for name, s, (*_, cost) in zip(models, scores, known)}


def sweep_centers(
    df: DataFrame, vector: str, start: Sequence[Sequence[float]], ks: Sequence[int], max_iters: Sequence[int]
) -> DataFrame:
    """One line of quality per number of clusters and of steps: ``k, max_iter, silhouette, cost``.

    The first k of the start's centers begin the model of k clusters. Passes over the
    rows are as many as the most steps, and two more, however large the grid is.
    """
    path = lloyd_steps(df, vector, {k: start[:k] for k in ks}, max(max_iters))
    models = {(k, m): path[m - 1][k].centers for k in ks for m in max_iters}
    found = [(k, m, s, c) for (k, m), (s, c) in model_scores(df, vector, models).items()]
    return df.sparkSession.createDataFrame(found, "k int, max_iter int, silhouette double, cost double")
