"""Outlier job: cluster, measure, flag, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.operators.clustering import apply_model, make_estimator, prepare
from strayline.operators.outliers import detect_outliers, report_with_histogram
from strayline.roles import Roles


@dataclass(frozen=True)
class CleaningResult:
    """All rows with distance and flag, and one report line per cluster."""

    rows: DataFrame
    report: DataFrame


def run(
    df: DataFrame,
    roles: Roles,
    algorithm: str = "GaussianMixture",
    standardize: bool = True,
    no_stddev: float = 2.0,
    n_buckets: int = 20,
    **params,
) -> CleaningResult:
    """Standardised by default, unlike classification."""
    prepared = cut(prepare(df, roles.features, standardize))
    model = make_estimator(algorithm, **params).fit(prepared)
    width = len(roles.features) if len(roles.features) > 1 else None
    scored = apply_model(model, prepared)
    flagged = detect_outliers(scored, no_stddev=no_stddev, width=width)
    dropped = [c for c in ("_vector", "probability") if c in flagged.columns]
    rows = flagged.drop(*dropped)
    return CleaningResult(rows, report_with_histogram(rows, n_buckets).orderBy(F.col("prediction")))
