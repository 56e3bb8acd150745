"""Logistic regression pipelines, cross validation and parameter grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession

from strayline.operators.features import DenseVector
from strayline.roles import Roles, as_names

ALGORITHMS = {"logisticregression": LogisticRegression}


def make_pipeline(
    features: str | Iterable[str],
    label: str,
    algorithm: str = "LogisticRegression",
    scale: bool = False,
    **params,
) -> Pipeline:
    """Assemble, densify, scale, classify. Ranges (tuples) are left to the grid."""
    fixed = {name: value for name, value in params.items() if not isinstance(value, tuple)}
    stages = [
        VectorAssembler(inputCols=list(as_names(features)), outputCol="v_features"),
        DenseVector(inputCol="v_features", outputCol="dense"),
        StandardScaler(inputCol="dense", outputCol="scaled", withMean=scale, withStd=scale),
        ALGORITHMS[algorithm.lower()](featuresCol="scaled", labelCol=label, **fixed),
    ]
    return Pipeline(stages=stages)


def equidistant_values(params: Mapping[str, object], steps: int = 3) -> dict[str, list]:
    """Ranges ``(low, high)`` as evenly spaced values; whole ranges are truncated."""
    found = {}
    for name, value in params.items():
        if not isinstance(value, tuple):
            continue
        low, high = value
        if steps == 1:
            spaced = [low]
        else:
            spaced = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        found[name] = [int(v) for v in spaced] if isinstance(low, int) else [float(v) for v in spaced]
    return found


def make_grid(model, params: Mapping[str, object], steps: int = 3) -> list[dict]:
    """Parameter maps from single values, lists and ranges."""
    builder = ParamGridBuilder()
    for name, value in {**params, **equidistant_values(params, steps)}.items():
        param = getattr(model, name)
        if isinstance(value, (list, tuple)):
            builder.addGrid(param, list(value))
        else:
            builder.baseOn({param: value})
    return builder.build()


def cross_validate(
    pipeline: Pipeline,
    data: DataFrame,
    evaluator: Evaluator,
    grid: list[dict],
    n_folds: int = 3,
    seed: int = 0,
    parallelism: int = 2,
) -> CrossValidatorModel:
    if not isinstance(evaluator, Evaluator):
        raise TypeError(f"{evaluator!r} is not an evaluator")
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid or [{}],
        evaluator=evaluator,
        numFolds=n_folds,
        seed=seed,
        parallelism=parallelism,
    )
    return validator.fit(data)


def fold_metrics(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """Average metric and deviation of every parameter map tried."""
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in params.items()), float(metric), float(deviation))
        for params, metric, deviation in zip(
            model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics
        )
    ]
    return spark.createDataFrame(rows, "params string, avg_metric double, std_metric double")


def result_columns(roles: Roles) -> list[str]:
    return [*roles.id, *roles.features, *roles.labels, "rawPrediction", "probability", "prediction"]
