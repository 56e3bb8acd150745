"""Models fitted with MLlib, and the jobs around them."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strayline.catalog.common import LINEITEM_FEATURES, query, table, vectors
from strayline.lineage import cut
from strayline.operators.classification import (
    cross_validate,
    fold_metrics,
    make_grid,
    make_pipeline,
)
from strayline.operators.clustering import (
    apply_model,
    component_table,
    make_estimator,
    model_centers,
    prepare,
    sweep,
    topics,
)
from strayline.operators.generative import (
    cluster_then_classify,
    majority_label,
    supervised_baseline,
)
from strayline.operators.metrics import classifier_curves
from strayline.operators.sampling import hash_split
from strayline.plans import classification, cleaning, semisupervised
from strayline.roles import Roles

PART_FEATURES = ["p_size", "p_retailprice"]
ORDER_FEATURES = ["o_totalprice", "month", "customer"]


def parts(spark, sf_dir):
    return prepare(table(spark, sf_dir, "part", "p_partkey", *PART_FEATURES), PART_FEATURES)


def orders(spark, sf_dir):
    """Orders with three numeric features and whether they are finished."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("finished"),
        "o_totalprice",
        F.month("o_orderdate").cast("double").alias("month"),
        F.col("o_custkey").cast("double").alias("customer"),
    )


@query("m01_gaussian_mixture")
def gaussian_mixture(spark, sf_dir):
    rows = parts(spark, sf_dir)
    model = make_estimator("GaussianMixture", k=3, seed=1, maxIter=10, not_a_parameter=1).fit(rows)
    return model.transform(rows).select("p_partkey", "prediction")


@query("m02_kmeans", "SELECT count(*) AS n, CAST(8 AS BIGINT) AS k FROM lineitem")
def kmeans(spark, sf_dir):
    """Line items in eight clusters: every row is in one."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", *LINEITEM_FEATURES)
    rows = prepare(items, LINEITEM_FEATURES)
    model = make_estimator("kmeans", k=8, seed=1, maxIter=5).fit(rows)
    return model.transform(rows).agg(
        F.count("prediction").alias("n"), F.countDistinct("prediction").alias("k")
    )


@query("m03_topics")
def document_topics(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return topics(documents, "text", k=5, max_iter=5, seed=1).select(
        "doc_id", "topic", F.round(F.array_max("topic_weights"), 4).alias("weight")
    )


@query("m04_apply_model", "SELECT p_partkey, TRUE AS has_center FROM part")
def scored_parts(spark, sf_dir):
    """Every part gets a cluster and that cluster's center."""
    rows = parts(spark, sf_dir)
    model = make_estimator("kmeans", k=4, seed=1).fit(rows)
    return apply_model(model, rows).select(
        "p_partkey", (F.size("centers") == 2).alias("has_center")
    )


@query("m05_center_table")
def centers(spark, sf_dir):
    return model_centers(spark, make_estimator("kmeans", k=4, seed=1).fit(parts(spark, sf_dir)))


@query("m06_component_table")
def components(spark, sf_dir):
    model = make_estimator("GaussianMixture", k=3, seed=1, maxIter=10).fit(parts(spark, sf_dir))
    return component_table(spark, model)


@query("m07_cleaning_job", "SELECT count(*) AS rows FROM part")
def cleaning_job(spark, sf_dir):
    """The whole job; its report covers every row once."""
    roles = Roles.of("p_partkey", "p_type", PART_FEATURES)
    result = cleaning.run(table(spark, sf_dir, "part"), roles, "kmeans", k=4, seed=1)
    return result.report.agg(F.sum("amount").alias("rows"))


@query("m07_mixture_job", "SELECT p_partkey, TRUE AS is_measured, TRUE AS is_judged FROM part")
def mixture_job(spark, sf_dir):
    """The job as it is by default: a mixture, its components' distances and flags."""
    roles = Roles.of("p_partkey", "p_type", PART_FEATURES)
    rows = cleaning.run(table(spark, sf_dir, "part"), roles, k=3, seed=1, maxIter=10).rows
    gaps = [F.pow(F.get("scaled_features", F.lit(i)) - F.get("centers", F.lit(i)), 2) for i in range(2)]
    beyond = F.col("distance") > F.col("computed_boundary")
    return rows.select(
        "p_partkey",
        (F.abs(F.col("distance") - F.sqrt(gaps[0] + gaps[1])) < 1e-9).alias("is_measured"),
        ((F.size("covariance") == 2) & (F.col("is_outlier") == beyond.cast("int"))).alias("is_judged"),
    )


@query("m08_logistic_regression")
def logistic_regression(spark, sf_dir):
    train, test = hash_split(orders(spark, sf_dir), "o_orderkey", 0.8, 8)
    model = make_pipeline(ORDER_FEATURES, "finished", scale=True, maxIter=10).fit(train)
    return model.transform(test).select(
        "o_orderkey",
        "finished",
        F.round(F.get(vector_to_array("probability"), F.lit(1)), 4).alias("probability"),
        "prediction",
    )


@query("m09_cross_validation")
def validated(spark, sf_dir):
    """Two folds over an even grid of one range."""
    pipeline = make_pipeline(ORDER_FEATURES, "finished", maxIter=5)
    grid = make_grid(pipeline.getStages()[-1], {"regParam": (0.01, 0.1)}, steps=2)
    evaluator = BinaryClassificationEvaluator(labelCol="finished")
    model = cross_validate(pipeline, cut(orders(spark, sf_dir)), evaluator, grid, n_folds=2)
    return fold_metrics(spark, model)


@query("m11_summary_curves")
def curves(spark, sf_dir):
    """All five curves of a fitted classifier and its area, over every scored row."""
    rows = orders(spark, sf_dir)
    scored = make_pipeline(ORDER_FEATURES, "finished", maxIter=5).fit(rows).transform(rows)
    probability = F.get(vector_to_array("probability"), F.lit(1)).alias("probability")
    return classifier_curves(scored.select("finished", probability), "finished", "probability")


@query("m12_model_sweep")
def model_sweep(spark, sf_dir):
    return sweep(cut(parts(spark, sf_dir)), "kmeans", (2, 3), (5, 10), seed=1)


def _labelled(spark, sf_dir):
    known = F.col("p_partkey") % 4 == 0
    half = F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "part", "p_partkey", *PART_FEATURES).withColumn(
        "used_label", F.when(known, half)
    )


@query("m13_cluster_then_classify", "SELECT p_partkey, TRUE AS is_scored, TRUE AS is_named FROM part")
def generative(spark, sf_dir):
    """Every part gets a predicted cluster and that cluster's most frequent known label."""
    scored = cluster_then_classify(_labelled(spark, sf_dir), PART_FEATURES, "used_label", folds=2)
    names = majority_label(scored, "used_label")
    return scored.join(names, "prediction", "left").select(
        "p_partkey",
        F.col("prediction").isin(0.0, 1.0).alias("is_scored"),
        F.col("majority_label").isNotNull().alias("is_named"),
    )


@query("m14_supervised_baseline")
def baseline(spark, sf_dir):
    _, scored = supervised_baseline(_labelled(spark, sf_dir), PART_FEATURES, "used_label", folds=2)
    return scored.select("p_partkey", "used_label", "prediction")


@query("p16_result_projection")
def classification_job(spark, sf_dir):
    roles = Roles.of("o_orderkey", "finished", ORDER_FEATURES)
    scored = classification.run(orders(spark, sf_dir), roles, maxIter=5, seed=3)
    return scored.withColumn("probability", vector_to_array("probability")).withColumn(
        "rawPrediction", vector_to_array("rawPrediction")
    )


@query("m15_semisupervised_job", "SELECT vec_id, TRUE AS is_labelled FROM embeddings")
def semisupervised_job(spark, sf_dir):
    """The job with two classes over all 64 features."""
    label = F.when(F.col("vec_id") % 3 == 0, (F.col("prediction") % 2).cast("double"))
    rows = vectors(spark, sf_dir).select(
        "vec_id", label.alias("label"), *[F.get("point", F.lit(i)).alias(f"f{i}") for i in range(64)]
    )
    roles = Roles.of("vec_id", "label", [f"f{i}" for i in range(64)])
    filled = semisupervised.run(rows, roles, sigma=0.6, standardize=False)
    return filled.select("vec_id", F.col("new_label").isin(0.0, 1.0).alias("is_labelled"))
