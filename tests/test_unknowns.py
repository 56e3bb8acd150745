"""Unknown values, odd labels and uneven vectors must not bend the answers of other rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayline.functions.vectors import width_of
from strayline.operators import clustering, logs
from strayline.operators.features import fit_scaler
from strayline.operators.graph import matrix_product, similarity_edges
from strayline.operators.metrics import area_under_roc, classifier_curves, threshold_curve
from strayline.operators.outliers import attach_centers, group_centers
from strayline.operators.propagation import label_propagation
from strayline.operators.sampling import bernoulli_with_replacement, enlarge, jittered

POINTS = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 1.0, 1.0), (3, 1.1, 1.0)]


def test_a_null_feature_takes_its_row_out_of_the_graph_only(spark):
    df = spark.createDataFrame([*POINTS, (4, None, 0.0), (5, math.nan, 1.0)], "id long, a double, b double")
    found = {(r.src, r.dst) for r in similarity_edges(df, "id", ["a", "b"], 0.3, 0.01, standardize=False).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (1, 0), (3, 2)}


def test_propagation_keeps_rows_it_cannot_place(spark):
    rows = [(i, a, b, [0.0, None, 1.0, None][i]) for i, a, b in POINTS]
    rows += [(4, None, 0.0, None), (5, math.nan, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    out = {r.id: r for r in label_propagation(df, "id", "label", ["a", "b"], k=2, sigma=0.3, tol=0.01, standardize=False).collect()}
    assert [out[i].new_label for i in range(6)] == [0.0, 0.0, 1.0, 1.0, None, 1.0]
    assert out[4].probabilities is None


def test_rows_may_share_an_id(spark):
    rows = [(0, 0.0, 0.0, 0.0), (7, 0.1, 0.0, None), (2, 1.0, 1.0, 1.0), (7, 1.1, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    out = label_propagation(df, "id", "label", ["a", "b"], k=2, sigma=0.3, tol=0.01, standardize=False).collect()
    assert {(r.id, r.a): r.new_label for r in out} == {(0, 0.0): 0.0, (7, 0.1): 0.0, (2, 1.0): 1.0, (7, 1.1): 1.0}


@pytest.mark.parametrize("label", [5.0, -1.0, 0.5])
def test_a_label_outside_the_classes_is_an_error(spark, label):
    df = spark.createDataFrame([(0, 0.0, label), (1, 1.0, 0.0)], "id long, a double, label double")
    with pytest.raises(ValueError, match="whole numbers"):
        label_propagation(df, "id", "label", ["a"], k=2)


def test_scaler_passes_over_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (math.nan,), (None,)], "x double")
    scaler = fit_scaler(df, ["x"])
    assert scaler.means == (2.0,) and scaler.highs == (3.0,)
    values = [r.v[0] for r in df.select(scaler.vector().alias("v")).collect()]
    assert values[0] == -values[1] and math.isnan(values[2]) and values[3] is None


def test_vectors_of_uneven_length_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 9.0],), (None,)], "v array<double>")
    with pytest.raises(ValueError, match="2 to 3"):
        width_of(df, "v")
    assert width_of(df.filter("size(v) = 2"), "v") == 2


def test_a_null_cluster_has_a_center(spark):
    df = spark.createDataFrame([(None, [1.0]), (None, [3.0]), (1, [5.0])], "prediction int, point array<double>")
    out = attach_centers(df, group_centers(df, "prediction", "point")).collect()
    assert sorted((r.prediction is None, r.centers) for r in out) == [(False, [5.0]), (True, [2.0]), (True, [2.0])]


@pytest.mark.parametrize("limits", [(1000, 1 << 20), (0, 1 << 20), (0, 32)])
def test_nearest_center_is_the_same_by_every_way(spark, monkeypatch, limits):
    monkeypatch.setattr(clustering, "EXPRESSION_LIMIT", limits[0])
    monkeypatch.setattr(clustering, "BROADCAST_LIMIT_BYTES", limits[1])
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(7, 2)).tolist()
    centers.append(centers[2])
    points = rng.normal(size=(40, 2)).tolist() + [centers[2]]
    rows = [(i, p) for i, p in enumerate(points)] + [(100, None), (101, [None, 1.0]), (102, [math.nan, 1.0])]
    df = spark.createDataFrame(rows, "id int, scaled_features array<double>")
    out = {r.id: r.prediction for r in clustering.nearest_center(df, centers).collect()}
    want = ((np.array(points)[:, None] - np.array(centers)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [out[i] for i in range(41)] == want.tolist()
    assert [out[i] for i in (100, 101, 102)] == [None] * 3


def test_curves_pass_over_unknown_labels(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (None, 0.95), (0, None), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    known = df.dropna()
    assert threshold_curve(df, "label", "score").count() == 4
    assert area_under_roc(df, "label", "score").first() == area_under_roc(known, "label", "score").first()
    curves = classifier_curves(df, "label", "score").collect()
    assert {r.curve for r in curves} == {"f_measure", "precision", "recall", "pr", "roc", "auc"}
    assert sum(r.curve == "roc" for r in curves) == 4
    assert [r.y for r in curves if r.curve == "auc"] == [0.75]


def test_every_piece_of_a_log_line_is_kept(spark):
    head = "2020-01-02 03:04:05,678:INFO:__main__:"
    lines = ["Iteration: 4 - data: x9 - Number of partions: 8", "Iteration: 4", "a: 1 - a: 2", "a: 1 - b: 2 - free text - c: 3"]
    df = spark.createDataFrame([(head + x,) for x in lines], "value string")
    found = [{k: v.strip() for k, v in r.parts.items()} for r in logs.split_lines(df).collect()]
    assert found == [{"Iteration": "4", "data": "x9", "Number of partions": "8"}, {"a": "2"}, {"a": "1", "b": "2", "c": "3"}]


def test_samples_do_not_hang_on_the_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("f"))
    for draw in (
        lambda x: bernoulli_with_replacement(x, 0.7, 3, ["id"]),
        lambda x: jittered(x, ["f"], 3, ["id"]),
        lambda x: enlarge(x, 5000, ["f"], 3, ["id"]),
    ):
        one, other = (sorted(map(tuple, draw(df.repartition(n)).collect())) for n in (1, 5))
        assert one == other
    n = bernoulli_with_replacement(df, 0.7, 3, ["id"]).count()
    assert abs(n - 2100) < 150
    assert abs(enlarge(df, 5000, ["f"], 3, ["id"]).count() - 5000) < 200


def test_product_with_hot_keys_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr("strayline.operators.skew.hot_keys.__defaults__", (20,))
    rng = np.random.default_rng(4)
    a = [(int(i), int(j if j else 0), 1.0) for i, j in zip(range(60), rng.integers(0, 2, 60))]
    b = [(int(i % 2), int(i), 2.0) for i in range(90)]
    entries = "src long, dst long, weight double"
    got = {(r.src, r.dst): r.weight for r in matrix_product(spark.createDataFrame(a, entries), spark.createDataFrame(b, entries)).collect()}
    want = {(i, d): 2.0 for i, j, _ in a for s, d, _ in b if j == s}
    assert got == want
