"""Gaussian mixtures: every step is one aggregate of weighed moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayline.functions.vectors import argmax
from strayline.operators.moments import first_width, matrix_of, total

#: Added to the diagonal of a covariance that cannot be inverted, as a share of its mean.
FLOOR = 1e-6


@dataclass
class Components:
    """Weights, means and covariances of a mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @classmethod
    def of_model(cls, model) -> Components:
        """Those of a mixture that MLlib has fitted."""
        parts = model.gaussiansDF.collect()
        return cls(
            np.array(model.weights), np.array([p["mean"].toArray() for p in parts]), np.array([p["cov"].toArray() for p in parts])
        )

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of each component's weight times density, ``[rows, components]``."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances)):
            try:
                half = np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:
                half = np.linalg.cholesky(cov + np.eye(len(cov)) * (FLOOR * np.trace(cov) / len(cov) + 1e-300))
            z = np.linalg.solve(half, (x - mean).T)
            log_weight = np.log(w) if w > 0 else -np.inf
            out[:, k] = log_weight - 0.5 * ((z * z).sum(axis=0) + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(half)).sum()
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each component's share in each row, and the rows' log likelihoods."""
        logs = self.log_densities(x)
        top = logs.max(axis=1)
        scaled = np.exp(logs - top[:, None])
        whole = scaled.sum(axis=1)
        return scaled / whole[:, None], top + np.log(whole)

    def table(self, spark: SparkSession) -> DataFrame:
        """``prediction, centers, covariance, weight``, a row per component."""
        rows = [(k, m.tolist(), c.tolist(), float(w)) for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances))]
        return spark.createDataFrame(
            rows, "prediction int, centers array<double>, covariance array<array<double>>, weight double"
        )


def _known(df: DataFrame, vector: str, *more: Column) -> DataFrame:
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), *more)
    return rows.filter("x IS NOT NULL AND NOT exists(x, e -> e IS NULL OR isnan(e))")


def _from_sums(sums: np.ndarray, k: int, d: int, about: np.ndarray, old: Components | None) -> Components:
    """Components from ``mass, sum, sum of products`` about given points; one without mass stays."""
    parts = sums.reshape(k, 1 + d + d * d)
    mass = parts[:, 0]
    weights, means, covariances = np.zeros(k), about.copy(), np.zeros((k, d, d))
    if old is not None:
        covariances = old.covariances.copy()
    for c in np.flatnonzero(mass > 0):
        off = parts[c, 1 : 1 + d] / mass[c]
        weights[c] = mass[c] / mass.sum()
        means[c] = about[c] + off
        covariances[c] = parts[c, 1 + d :].reshape(d, d) / mass[c] - np.outer(off, off)
    return Components(weights, means, covariances)


def _weighed(x: np.ndarray, shares: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Mass, sums and products of the rows for each component, about its point."""
    out = []
    for c in range(shares.shape[1]):
        off, own = x - about[c], shares[:, c]
        out.append(np.concatenate(([own.sum()], own @ off, ((off * own[:, None]).T @ off).ravel())))
    return np.concatenate(out)


def grouped_components(df: DataFrame, vector: str, group: Column, k: int) -> Components:
    """Components from a first grouping of the rows: ``group`` is a number below ``k``."""
    width = first_width(df, vector)
    if width is None:
        raise ValueError(f"column {vector!r} holds no vector")
    rows = _known(df, vector, group.cast("int").alias("g")).filter("g IS NOT NULL")
    first = rows.select("x").first()
    about = np.repeat(np.array(first["x"], float)[None], k, axis=0) if first else np.zeros((k, width))

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        own = np.asarray(batch.column("g"))[:, None] == np.arange(k)[None, :]
        return _weighed(matrix_of(batch.column("x"), width), own.astype(float), about)

    return _from_sums(total(rows, k * (1 + width + width * width), partial), k, width, about, None)


def mixture_step(df: DataFrame, vector: str, components: Components) -> tuple[Components, float]:
    """The next components, and the mean log likelihood under the given ones.

    Every row's shares weigh its part in the next weights, means and covariances. Tasks add
    them up; ``k * (1 + d + d * d)`` sums reach the driver. Rows with an unknown element
    take no part; a component in which no row has a share keeps its place with weight 0.
    """
    k, d = components.means.shape

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix_of(batch.column("x"), d)
        shares, logs = components.shares(x)
        return np.concatenate((_weighed(x, shares, components.means), [logs.sum(), len(x)]))

    sums = total(_known(df, vector), k * (1 + d + d * d) + 2, partial)
    if not sums[-1]:
        return components, float("nan")
    return _from_sums(sums[:-2], k, d, components.means, components), float(sums[-2] / sums[-1])


def fit_mixture(df: DataFrame, vector: str, start: Components, steps: int = 100, tol: float = 1e-9) -> Components:
    """Steps from given components until the mean log likelihood gains no more than ``tol``."""
    now, last = start, -np.inf
    for _ in range(steps):
        now, score = mixture_step(df, vector, now)
        if not score > last + tol:
            break
        last = score
    return now


def apply_mixture(df: DataFrame, vector: str, components: Components, prediction: str = "prediction") -> DataFrame:
    """Adds ``probability``, each component's share, and the number of the largest one.

    Both are NULL for a row with an unknown element; the lowest number wins ties.
    """

    @F.pandas_udf("array<double>")
    def shares(points: pd.Series) -> pd.Series:
        out: list = [None] * len(points)
        known = [k for k, p in enumerate(points) if p is not None and not np.isnan(np.asarray(p, float)).any()]
        if known:
            found = components.shares(np.stack([np.asarray(points.iloc[k], float) for k in known]))[0]
            for k, own in zip(known, found):
                out[k] = own
        return pd.Series(out, index=points.index, dtype=object)

    return df.withColumn("probability", shares(F.col(vector).cast("array<double>"))).withColumn(
        prediction, argmax("probability").cast("int")
    )
