"""Clustering with MLlib and the tables around its models."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import clustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayline.functions.vectors import element_sql, number_sql, squared_distance
from strayline.lineage import BROADCAST_LIMIT_BYTES, bounded_broadcast, cut
from strayline.operators.features import standardize
from strayline.operators.row_ids import add_row_id
from strayline.operators.topics import counted, dealt, online_topics

# Up to this many numbers the centers are written into the expression. The plan
# changes with the number of centers, the answer does not.
EXPRESSION_LIMIT = 128

ALGORITHMS = {
    "gaussianmixture": clustering.GaussianMixture,
    "kmeans": clustering.KMeans,
}


def make_estimator(algorithm: str = "GaussianMixture", features_col: str = "_vector", **params):
    """Estimator by name; parameters it does not have are left out."""
    maker = ALGORITHMS[algorithm.lower()]
    known = {p.name for p in maker().params}
    return maker(featuresCol=features_col, **{n: v for n, v in params.items() if n in known})


def prepare(df: DataFrame, features: str | Iterable[str], scale: bool = True) -> DataFrame:
    """Add ``scaled_features`` as an array and as an ML vector."""
    return standardize(df, features, "scaled_features", scale).withColumn(
        "_vector", array_to_vector("scaled_features")
    )


def component_table(spark: SparkSession, model) -> DataFrame:
    """Mixture components: ``prediction, centers, covariance, weight``."""
    gaussians = model.gaussiansDF.collect()
    rows = [
        (
            i,
            [float(x) for x in g["mean"].toArray()],
            [[float(x) for x in line] for line in g["cov"].toArray()],
            float(w),
        )
        for i, (g, w) in enumerate(zip(gaussians, model.weights))
    ]
    return spark.createDataFrame(
        rows, "prediction int, centers array<double>, covariance array<array<double>>, weight double"
    )


def center_table(spark: SparkSession, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Cluster number and center, from a fitted model's centers."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "prediction int, centers array<double>")


def model_centers(spark: SparkSession, model) -> DataFrame:
    """Cluster number and center; of a mixture the covariance, too."""
    if hasattr(model, "gaussiansDF"):
        return component_table(spark, model).drop("weight")
    return center_table(spark, model.clusterCenters())


def apply_model(model, df: DataFrame) -> DataFrame:
    """Score prepared rows and attach each row's own center, of a mixture the covariance, too."""
    spark = df.sparkSession
    if hasattr(model, "gaussiansDF"):
        k, width = len(model.weights), model.numFeatures
    else:
        centers = model.clusterCenters()
        k, width = len(centers), len(centers[0])
    numbers = width + width * width if hasattr(model, "gaussiansDF") else width
    centers = bounded_broadcast(model_centers(spark, model), k, 8 * numbers + 16)
    return model.transform(df).join(centers, "prediction")


def own_center_distance(df: DataFrame, centers: DataFrame, k: int, width: int,
                        point: str = "scaled_features", cluster: str = "prediction") -> DataFrame:
    """Join centers on the cluster and add ``distance``; broadcast when k rows are small."""
    joined = df.join(bounded_broadcast(centers, k, 8 * width + 16), cluster)
    return joined.withColumn("distance", F.sqrt(squared_distance(point, "centers", width)))


def nearest_center(
    df: DataFrame, centers: Sequence[Sequence[float]], point: str = "scaled_features",
    output: str = "prediction",
) -> DataFrame:
    """Number of the closest given center, the lowest one on ties; NULL for an unknown point.

    A point with a NULL or NaN element is unknown, too. A few short centers become
    part of the expression, inside codegen. Larger ones, whose code would be too
    long, are compared in Arrow batches. Of centers that are too large for every
    task, one block after the other is, and each point keeps its best so far.
    """
    width = len(centers[0])
    block = max(1, BROADCAST_LIMIT_BYTES // (8 * width))
    if len(centers) > block:
        return _nearest_in_blocks(df, centers, point, output, block)
    if len(centers) * width > EXPRESSION_LIMIT:
        return df.withColumn(output, _nearest_in_batches(centers)(F.col(point)))
    terms = element_sql(point, width)
    candidates = []
    for i, center in enumerate(centers):
        gaps = [f"({x} - {number_sql(c)})" for x, c in zip(terms, center)]
        squares = " + ".join(f"{g} * {g}" for g in gaps)
        candidates.append(f"struct({squares} AS d2, {i} AS i)")
    best = f"least({', '.join(candidates)})" if len(candidates) > 1 else candidates[0]
    known = " AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in terms)
    return df.withColumn(output, F.expr(f"CASE WHEN {known} THEN {best}.i END"))


def _known(points: pd.Series) -> tuple[pd.Series, np.ndarray]:
    """Which points have no unknown element, and those points."""
    known = points.map(lambda p: p is not None and not pd.isna(np.asarray(p, dtype=float)).any()).astype(bool)
    rows = np.stack([np.asarray(p, dtype=float) for p in points[known]]) if known.any() else np.zeros((0, 1))
    return known, rows


def _nearest_in_blocks(df: DataFrame, centers, point: str, output: str, block: int) -> DataFrame:
    """The closest of very many centers: a pass over the points per block of centers."""
    best = df.withColumn("_best", F.lit(None).cast("struct<gap: double, number: int>"))
    for start in range(0, len(centers), block):
        fixed = np.asarray(centers[start : start + block], dtype=float)
        best = cut(best.withColumn("_best", F.least("_best", _closest(fixed, start)(F.col(point)))))
    return best.withColumn(output, F.col("_best.number")).drop("_best")


def _closest(fixed: np.ndarray, start: int):
    @F.pandas_udf("struct<gap: double, number: int>")
    def closest(points: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame({"gap": None, "number": None}, index=points.index, dtype=object)
        known, rows = _known(points)
        if known.any():
            squares = np.stack([((rows - c) ** 2).sum(axis=1) for c in fixed], axis=1)
            at = squares.argmin(axis=1)
            found.loc[known, "gap"] = squares[np.arange(len(rows)), at]
            found.loc[known, "number"] = at + start
        return found.astype({"gap": "float64", "number": "Int32"})

    return closest


def _nearest_in_batches(centers: Sequence[Sequence[float]]):
    fixed = np.asarray(centers, dtype=float)

    @F.pandas_udf("int")
    def closest(points: pd.Series) -> pd.Series:
        found = pd.Series(None, index=points.index, dtype="Int32")
        known, rows = _known(points)
        if known.any():
            squares = np.stack([((rows - c) ** 2).sum(axis=1) for c in fixed], axis=1)
            found[known] = squares.argmin(axis=1)
        return found

    return closest


def sweep(
    df: DataFrame,
    algorithm: str = "kmeans",
    ks: Sequence[int] = (2, 3),
    max_iters: Sequence[int] = (10,),
    seed: int = 0,
) -> DataFrame:
    """Fit every (k, maxIter) on prepared rows; one line of quality per model."""
    estimator = make_estimator(algorithm, seed=seed)
    grid = list(itertools.product(ks, max_iters))
    maps = [{estimator.k: k, estimator.maxIter: m} for k, m in grid]
    evaluator = ClusteringEvaluator(featuresCol="_vector")
    rows = []
    for (k, iterations), model in zip(grid, estimator.fit(df, maps)):
        cost = getattr(model.summary, "trainingCost", None) or model.summary.logLikelihood
        rows.append((k, iterations, float(evaluator.evaluate(model.transform(df))), float(cost)))
    return df.sparkSession.createDataFrame(
        rows, "k int, max_iter int, silhouette double, training_score double"
    )


def topics(
    df: DataFrame, text: str, k: int = 10, max_iter: int = 10, vocabulary: int | None = None, seed: int = 0
) -> DataFrame:
    """Topic of each text by LDA on its words: adds ``topic`` and ``topic_weights``.

    Every word counts: the vocabulary is all different words, unless a caller names a
    smaller number and gives up the rarest words. The model is a table of words: MLlib's
    holds ``k`` numbers per word on the driver several times. A text without words has weights of 0.
    """
    # Texts are known by a number, which must not change when they are read again.
    rows = cut(add_row_id(df, "_row"))
    texts = dealt(rows.select(F.col("_row").alias("doc"), F.col(text).alias("_text")), "doc")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+").transform(texts)
    counts = counted(words.select("doc", F.explode("_words").alias("word")))
    if vocabulary is not None:
        counts = cut(counts)
        often = counts.groupBy("word").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "word").limit(vocabulary)
        counts = counts.join(often.select("word"), "word", "left_semi")
    shares = online_topics(counts, rows.count(), k, max_iter, seed).select(F.col("doc").alias("_row"), F.col("topics").alias("_shares"))
    found = rows.join(shares, "_row", "left").withColumn("topic_weights", F.coalesce("_shares", F.array(*[F.lit(0.0)] * k)))
    return found.withColumn("topic", F.array_position("topic_weights", F.array_max("topic_weights")) - 1).drop("_row", "_shares")
