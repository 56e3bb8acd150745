"""Semi-supervised classification by clustering first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.operators.classification import cross_validate
from strayline.operators.clustering import nearest_center
from strayline.operators.features import known_label, split_known, standardize
from strayline.operators.lloyd import lloyd_steps
from strayline.operators.newton import best_regularisation, cross_validated, fit_logistic, fold_measures, scored
from strayline.roles import as_names

# The regularisations tried.
REGULARISATIONS = [0.1, 0.01]

_CLUSTER = "cluster"


def class_counts(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Number ``k`` of distinct known labels, in the whole table or per group."""
    return df.filter(known_label(df, label)).groupBy(*by).agg(F.countDistinct(label).alias("k"))


def class_count(df: DataFrame, label: str) -> int:
    return class_counts(df, label).first()["k"]


def _evaluator(k: int, label: str):
    if k <= 2:
        return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    return MulticlassClassificationEvaluator(labelCol=label, metricName="f1")


def cluster_then_classify(
    df: DataFrame,
    features: str | Iterable[str],
    label: str = "label",
    prediction: str = "prediction",
    folds: int = 3,
    seed: int = 0,
) -> DataFrame:
    """KMeans with one cluster per known label, then a classifier of the clusters.

    Area under ROC picks the regularisation for two classes, F1 for more.
    """
    k = class_count(df, label)
    if k < 2:
        raise ValueError("needs at least two known labels")
    assembler = VectorAssembler(inputCols=list(as_names(features)), outputCol="features")
    clusters = KMeans(featuresCol="features", predictionCol=_CLUSTER, k=k, seed=seed)
    classifier = LogisticRegression(
        featuresCol="features", labelCol=_CLUSTER, predictionCol=prediction
    )
    grid = ParamGridBuilder().addGrid(classifier.regParam, REGULARISATIONS).build()
    evaluator = _evaluator(k, _CLUSTER)
    if k > 2:
        evaluator.setPredictionCol(prediction)
    pipeline = Pipeline(stages=[assembler, clusters, classifier])
    return cross_validate(pipeline, df, evaluator, grid, folds, seed).transform(df)


def majority_label(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Most frequent known label of each predicted cluster, the smallest on ties."""
    counts = df.filter(known_label(df, label)).groupBy(prediction, label).count()
    best = F.max_by(F.col(label), F.struct(F.col("count"), -F.col(label)))
    return counts.groupBy(prediction).agg(best.alias("majority_label"))


def supervised_baseline(
    df: DataFrame,
    features: str | Iterable[str],
    label: str,
    prediction: str = "prediction",
    folds: int = 3,
    seed: int = 0,
) -> tuple[CrossValidatorModel, DataFrame]:
    """The same classifier trained on the known labels alone."""
    known, _ = split_known(df, label)
    assembler = VectorAssembler(inputCols=list(as_names(features)), outputCol="features")
    classifier = LogisticRegression(featuresCol="features", labelCol=label, predictionCol=prediction)
    grid = ParamGridBuilder().addGrid(classifier.regParam, REGULARISATIONS).build()
    k = class_count(df, label)
    evaluator = _evaluator(k, label)
    if k > 2:
        evaluator.setPredictionCol(prediction)
    model = cross_validate(Pipeline(stages=[assembler, classifier]), known, evaluator, grid, folds, seed)
    return model, model.transform(df)


def checked_baseline(
    df: DataFrame,
    features: str | Iterable[str],
    label: str,
    keys: Iterable[str],
    folds: int = 3,
    seed: int = 0,
    steps: int = 12,
) -> DataFrame:
    """All rows scored by a regression of the known 0/1 labels, in Newton steps.

    The regularisation with the smallest loss over folds by key is taken; the models of
    all folds are fitted in the same passes.
    """
    keys = list(keys)
    _, scores = cross_validated(df, features, label, keys, REGULARISATIONS, folds, seed, steps)
    best = best_regularisation(fold_measures(scores, label))
    return scored(df, fit_logistic(df, features, label, (best,), steps=steps)[0])


def clusters_by_steps(
    df: DataFrame,
    features: str | Iterable[str],
    label: str,
    start,
    regularisation: float = 0.01,
    cluster_steps: int = 10,
    steps: int = 12,
) -> DataFrame:
    """Two clusters from given centers, a classifier of them, and each class's most frequent known label.

    Adds ``cluster``, ``probability``, ``prediction`` and ``majority_label``. The centers are
    of standardised features and move as ``lloyd_steps`` moves them; the classifier is a
    regression of the cluster in Newton steps. Rows with an unknown feature have NULLs.
    """
    k = class_count(df, label)
    if k != 2 or len(start) != 2:
        raise ValueError(f"needs two known labels and two centers, not {k} and {len(start)}")
    rows = cut(standardize(df, features, "_scaled"))
    centers = lloyd_steps(rows, "_scaled", {0: start}, cluster_steps)[-1][0].centers.tolist()
    clustered = nearest_center(rows, centers, "_scaled", "cluster").drop("_scaled")
    model = fit_logistic(clustered, features, "cluster", (regularisation,), steps=steps)[0]
    found = cut(scored(clustered, model).drop("rawPrediction"))
    names = majority_label(found, label).withColumnRenamed("prediction", "_class")
    return found.join(names, F.col("prediction") == F.col("_class"), "left").drop("_class")
