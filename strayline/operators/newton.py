"""Logistic regression by Newton steps, each one aggregate of sums for any number of models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.functions.text import hash_unit
from strayline.functions.vectors import number_sql
from strayline.operators.features import Scaler, fit_scaler, known_label
from strayline.operators.moments import matrix_of, total


@dataclass
class LogisticModel:
    """One fitted model: weights of the standardised features, the intercept last.

    ``path`` holds them after each step, ``fold`` is the fold the model has not seen.
    """

    scaler: Scaler
    regularisation: float
    fold: int | None
    weights: np.ndarray
    path: list[np.ndarray]

    def coefficients(self) -> tuple[list[float], float]:
        """Coefficients and intercept for the features as they are."""
        stds = np.array(self.scaler.stds)
        own = np.where(stds > 0, self.weights[:-1] / np.where(stds > 0, stds, 1.0), 0.0)
        return own.tolist(), float(self.weights[-1] - own @ np.array(self.scaler.means))

    def log_odds(self) -> Column:
        own, intercept = self.coefficients()
        terms = [f"{number_sql(w)} * ({x})" for w, x in zip(own, self.scaler.terms)]
        return F.expr(" + ".join([*terms, number_sql(intercept)]))

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds()))


def fold_number(keys: Iterable[str], n_folds: int, seed: int = 0) -> Column:
    """Fold of a row by a hash of its key: the same on every partitioning."""
    return F.least(F.floor(hash_unit(*keys, seed=seed) * n_folds), F.lit(n_folds - 1)).cast("int")


def fit_logistic(
    df: DataFrame,
    features: str | Iterable[str],
    label: str,
    regularisations: Sequence[float] = (0.0,),
    fold: Column | None = None,
    n_folds: int = 0,
    steps: int = 12,
    tol: float = 1e-12,
) -> list[LogisticModel]:
    """Models of a 0/1 label, one per regularisation, and per fold left out if there are any.

    Minimises the mean logistic loss plus half the regularisation times the squares of the
    standardised features' weights, the intercept left free, from all weights 0. Each step
    is one pass over the table for all models together: tasks add up the gradients and
    curvatures, and only those sums reach the driver. A step that makes the loss worse
    is halved. A model is done when its weights move by no more than ``tol``. Rows with
    an unknown label or feature take no part; a feature without spread gets the weight 0.
    """
    scaler = fit_scaler(df, features)
    d = len(scaler.terms)
    known = F.col(label).cast("double").alias("y")
    rows = df.filter(known_label(df, label)).select(
        scaler.vector().alias("x"), known, (fold if fold is not None else F.lit(-1)).cast("int").alias("fold")
    ).filter("NOT exists(x, e -> e IS NULL OR isnan(e))")
    odd = rows.filter("y NOT IN (0.0, 1.0)").select("y").first()
    if odd is not None:
        raise ValueError(f"labels in {label!r} must be 0 or 1, not {odd['y']}")
    folds = list(range(n_folds)) if n_folds else [None]
    wanted = [(float(r), f) for r in regularisations for f in folds]
    c = d + 1
    each = 2 + c + c * c

    weights = np.zeros((len(wanted), c))
    before, losses, paths = weights.copy(), np.full(len(wanted), np.inf), [[] for _ in wanted]
    open_ = np.ones(len(wanted), bool)
    ridge = np.diag([1.0] * d + [0.0])
    for _ in range(2 * steps):
        at, left_out = weights.copy(), [f for _, f in wanted]

        def partial(batch: pa.RecordBatch, at=at, left_out=left_out, open_=open_.copy()) -> np.ndarray:
            x = np.hstack([matrix_of(batch.column("x"), d), np.ones((batch.num_rows, 1))])
            y, own = np.asarray(batch.column("y")), np.asarray(batch.column("fold"))
            sums = np.zeros((len(at), each))
            for m in np.flatnonzero(open_):
                use = np.ones(len(y), bool) if left_out[m] is None else own != left_out[m]
                xs, ys = x[use], y[use]
                z = xs @ at[m]
                p = 0.5 * (1.0 + np.tanh(0.5 * z))
                sums[m, 0] = len(ys)
                sums[m, 1] = (np.logaddexp(0.0, z) - ys * z).sum()
                sums[m, 2 : 2 + c] = xs.T @ (ys - p)
                sums[m, 2 + c :] = ((xs * (p * (1.0 - p))[:, None]).T @ xs).ravel()
            return sums.ravel()

        sums = total(rows, len(wanted) * each, partial).reshape(len(wanted), each)
        for m in np.flatnonzero(open_):
            n, r = sums[m, 0], wanted[m][0]
            if not n:
                open_[m] = False
                continue
            loss = sums[m, 1] / n + 0.5 * r * (weights[m, :-1] ** 2).sum()
            if loss > losses[m] + 1e-12:
                weights[m] = 0.5 * (weights[m] + before[m])
                continue
            if np.isfinite(losses[m]):
                paths[m].append(weights[m].copy())
            if len(paths[m]) >= steps or paths[m] and np.abs(weights[m] - before[m]).max() <= tol:
                open_[m] = False
                continue
            losses[m], before[m] = loss, weights[m].copy()
            gradient = sums[m, 2 : 2 + c] / n - r * (ridge @ weights[m])
            curvature = sums[m, 2 + c :].reshape(c, c) / n + r * ridge
            weights[m] = weights[m] + np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        if not open_.any():
            break
    for m in np.flatnonzero(open_):  # out of steps: keep the best that was measured
        weights[m] = before[m]
    return [LogisticModel(scaler, r, f, w, p) for (r, f), w, p in zip(wanted, weights, paths)]


def scored(df: DataFrame, model: LogisticModel) -> DataFrame:
    """Adds ``rawPrediction``, ``probability`` (both of class 0 and 1) and ``prediction``.

    They are NULL where a feature is.
    """
    with_odds = df.withColumn("_odds", model.log_odds())
    p = 1.0 / (1.0 + F.exp(-F.col("_odds")))
    known = F.col("_odds").isNotNull()
    return (
        with_odds.withColumn("rawPrediction", F.when(known, F.array(-F.col("_odds"), F.col("_odds"))))
        .withColumn("probability", F.when(known, F.array(1.0 - p, p)))
        .withColumn("prediction", F.when(known, F.when(F.col("_odds") > 0, 1.0).otherwise(0.0)))
        .drop("_odds")
    )


def cross_validated(
    df: DataFrame,
    features: str | Iterable[str],
    label: str,
    keys: Sequence[str],
    regularisations: Sequence[float],
    n_folds: int = 3,
    seed: int = 0,
    steps: int = 12,
) -> tuple[list[LogisticModel], DataFrame]:
    """All models, and every labelled row scored by those that have not seen its fold.

    The scored table has ``fold, regularisation, probability`` besides the columns of
    ``df``, a row per regularisation. Folds hang on a hash of the key, all models of the
    grid are advanced in the same passes.
    """
    fold = fold_number(keys, n_folds, seed)
    models = fit_logistic(df, features, label, regularisations, fold, n_folds, steps)
    each = []
    for r in regularisations:
        p = F.lit(None).cast("double")
        for m in models:
            if m.regularisation == float(r):
                p = F.when(F.col("fold") == m.fold, m.probability()).otherwise(p)
        each.append(F.struct(F.lit(float(r)).alias("regularisation"), p.alias("probability")))
    rows = df.filter(known_label(df, label)).withColumn("fold", fold)
    return models, rows.select("*", F.inline(F.array(*each)))


def fold_measures(scores: DataFrame, label: str) -> DataFrame:
    """``regularisation, fold, n, log_loss, accuracy`` of a scored table, in one aggregate."""
    y, p = F.col(label).cast("double"), F.col("probability")
    # An impossible probability of 0 or 1 counts as a hair beside it.
    bounded = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(y * F.log(bounded) + (1 - y) * F.log(1 - bounded))
    right = F.when((p > 0.5).cast("double") == y, 1.0).otherwise(0.0)
    return scores.filter(p.isNotNull()).groupBy("regularisation", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("log_loss"), F.avg(right).alias("accuracy")
    )


def best_regularisation(measures: DataFrame) -> float:
    """The one with the smallest mean loss over the folds; the smallest value on ties."""
    means = measures.groupBy("regularisation").agg(F.avg("log_loss").alias("loss"))
    return means.orderBy("loss", "regularisation").first()["regularisation"]
