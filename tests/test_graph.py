"""Similarity graphs, products and label propagation against golden values and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayline.operators import skew
from strayline.operators.graph import (
    block_pairs,
    degrees,
    matrix_product,
    mirrored,
    rows_of,
    similarity_edges,
    transition_matrix,
)
from strayline.operators.propagation import (
    class_mass_normalization,
    class_priors,
    label_matrix,
    label_propagation,
    propagate,
    propagation_step,
)

NODES = [(0, 0.0, 0.0), (1, 1.0, 0.9), (2, None, 0.1), (3, None, 0.85)]
WEIGHTS = [
    [1, 0.00006007, 0.88692, 0.00017],
    [0.00006007, 1, 0.00046, 0.97045],
    [0.88692, 0.00046, 1, 0.00117],
    [0.00017, 0.97045, 0.00117, 1],
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, label, x, x, x) for i, label, x in NODES]
    return spark.createDataFrame(rows, "id bigint, label double, a double, b double, c double")


@pytest.fixture(scope="module")
def edges(nodes):
    return similarity_edges(nodes, "id", ["a", "b", "c"], 0.5, 1e-9, standardize=False)


def test_weights(edges):
    found = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    assert len(found) == 10
    for (i, j), w in found.items():
        assert i >= j
        assert w == pytest.approx(WEIGHTS[i][j], abs=5e-6)


def test_degrees(edges):
    found = {r["id"]: r["degree"] for r in degrees(edges).collect()}
    want = {0: 1.88715007, 1: 1.97097007, 2: 1.88858, 3: 1.97178}
    assert found == pytest.approx(want, abs=1e-4)


def test_rows_of_the_transition_matrix_sum_to_one(edges):
    sums = transition_matrix(edges).groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert [r["s"] for r in sums] == pytest.approx([1.0] * 4)


def test_one_step(nodes, edges):
    scores = propagation_step(transition_matrix(edges), label_matrix(nodes, k=2), 2)
    found = {r["id"]: r["scores"] for r in scores.collect()}
    want = {0: [1, 0], 1: [0, 1], 2: [0.73480, 0.26520], 3: [0.25392, 0.74608]}
    for i in range(4):
        assert found[i] == pytest.approx(want[i], abs=6e-6)


@pytest.mark.parametrize("normalization", ["row_stochastic", "folded"])
@pytest.mark.parametrize("steps", [1, 7])
def test_propagation_against_dense_matrices(nodes, normalization, steps):
    x = np.array([[v] * 3 for _, _, v in NODES])
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.25)
    if normalization == "row_stochastic":
        t = w / w.sum(axis=0)
        t = t / t.sum(axis=1, keepdims=True)
    else:
        low = np.tril(w)
        full = lambda m: m + m.T - np.diag(np.diag(m))
        low = low / full(low).sum(axis=1)[None, :]
        low = low / full(low).sum(axis=1)[:, None]
        t = full(low)
    y = np.array([[1, 0], [0, 1], [0.5, 0.5], [0.5, 0.5]], dtype=float)
    start = y.copy()
    for _ in range(steps):
        y = t @ y
        y[:2] = start[:2]
    filled = label_propagation(
        nodes, feature_cols=["a", "b", "c"], k=2, sigma=0.5, max_iters=steps,
        standardize=False, normalization=normalization,
    )
    found = {r["id"]: r for r in filled.collect()}
    for i in range(4):
        assert found[i]["probabilities"] == pytest.approx(list(y[i]), abs=1e-9)
        assert found[i]["new_label"] == float(y[i].argmax())


def test_copies_count_like_separate_nodes(spark):
    """Merged copies, labelled differently even, give what single nodes give."""
    rng = random.Random(3)
    places = [(rng.random(), rng.random()) for _ in range(12)]
    rows = []
    for i in range(60):
        place = places[0] if i % 3 == 0 else places[rng.randrange(12)]
        rows.append((i, float(rng.randrange(3)) if i % 4 == 0 else math.nan, *place))
    df = spark.createDataFrame(rows, "id bigint, label double, a double, b double")
    x = np.array([r[2:] for r in rows])
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.09)
    w[w <= 0.05] = 0
    t = w / w.sum(axis=0)
    t = t / t.sum(axis=1, keepdims=True)
    known = np.array([not math.isnan(r[1]) for r in rows])
    start = np.array([[float(c == r[1]) if k else 0.5 for c in range(3)] for r, k in zip(rows, known)])
    y = start.copy()
    for _ in range(6):
        y = t @ y
        y[known] = start[known]
    filled = label_propagation(
        df, feature_cols=["a", "b"], k=3, sigma=0.3, tol=0.05, max_iters=6, standardize=False
    )
    for r in filled.collect():
        assert r["probabilities"] == pytest.approx(list(y[r["id"]]), abs=1e-9)


def test_early_stop_and_text_labels(spark):
    rows = [(0, "left", 0.0), (1, "right", 1.0), (2, None, 0.1), (3, None, 0.9)]
    df = spark.createDataFrame(rows, "id bigint, side string, a double")
    filled = label_propagation(
        df, label_col="side", feature_cols=["a"], sigma=0.4, max_iters=500,
        standardize=False, tol_converge=1e-12,
    )
    assert {r["id"]: r["new_side"] for r in filled.collect()} == {
        0: "left", 1: "right", 2: "left", 3: "right",
    }


@pytest.mark.parametrize("dimensions,tol", [(1, 0.01), (2, 0.3), (3, 0.01), (5, 1e-4)])
def test_edges_equal_brute_force(spark, dimensions, tol):
    rng = np.random.default_rng(dimensions)
    x = rng.random((400, dimensions)) * 4
    x[::3] = x[0] + rng.random((len(x[::3]), dimensions)) * 0.05  # a third in one place
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    found = {
        (r["src"], r["dst"]): r["weight"]
        for r in similarity_edges(df, "id", "v", 0.3, tol, standardize=False, block_rows=16).collect()
    }
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.09)
    want = {(i, j): w[i, j] for i in range(400) for j in range(i + 1) if w[i, j] > tol}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_edges_far_from_the_origin(spark):
    rows = [(i, [1e6 + 0.001 * i, -1e6]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    edges = similarity_edges(df, "id", "v", 0.01, 0.01, standardize=False, block_rows=8).collect()
    reach = 0.01 * math.sqrt(-math.log(0.01))
    assert len(edges) == sum(1 for i in range(50) for j in range(i + 1) if (i - j) * 0.001 < reach)


def test_an_unbounded_graph_is_refused(nodes):
    with pytest.raises(ValueError):
        similarity_edges(nodes, "id", ["a"], 0.5, 0.0)


def test_triangle_times_matrix(spark):
    triangle = [(1,), (2, 1), (3, 4, 1), (5, 6, 7, 1), (1, 4, 2, 1, 1), (1, 1, 1, 1, 1, 1)]
    a = [(i, j, float(v)) for i, row in enumerate(triangle) for j, v in enumerate(row)]
    y = [[1, 0, 0], [0, 1, 0], [0, 0, 1]] + [[0.5] * 3] * 3
    b = [(i, j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row) if v]
    schema = "src bigint, dst bigint, weight double"
    found = matrix_product(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), True)
    want = [(4.5, 5.5, 6.5), (7.5, 6.5, 9.5), (8, 9, 6), (6.5, 7.5, 8.5), (2.5, 5.5, 3.5), (2.5, 2.5, 2.5)]
    rows = {r["id"]: tuple(r["scores"]) for r in rows_of(found, 3).collect()}
    assert [rows[i] for i in range(6)] == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_join_like_plain_joins(spark, monkeypatch, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)], "k int, a int")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 60, 2)] + [(1, 7), (1, 8)], "k int, b int")
    hot = skew.hot_keys(left, ["k"], 10)
    assert [r["k"] for r in hot.collect()] == [1]
    spread = skew.salted_join(left, right, ["k"], ["a"], how, hot, counted=True)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_hot_nodes_propagate_alike(nodes, edges, monkeypatch):
    plain = {r["id"]: r["scores"] for r in propagate(transition_matrix(edges), label_matrix(nodes, k=2), 2, 4).collect()}
    small = skew.hot_keys
    monkeypatch.setattr("strayline.operators.propagation.hot_keys", lambda df, keys: small(df, keys, 1))
    spread = {r["id"]: r["scores"] for r in propagate(transition_matrix(edges), label_matrix(nodes, k=2), 2, 4).collect()}
    for i in plain:
        assert spread[i] == pytest.approx(plain[i])


PRIOR_ROWS = [
    (0, 1.0, [0.0, 1.0]), (1, 0.0, [1.0, 0.0]), (2, 0.0, [0.73, 0.27]),
    (3, None, [0.613, 0.387]), (4, None, [0.51, 0.49]), (5, None, [0.1, 0.9]),
]


def test_priors(spark):
    df = spark.createDataFrame(PRIOR_ROWS, "index bigint, label double, scores array<double>")
    shares = {r["label"]: r["prior"] for r in class_priors(df, "label").collect()}
    assert shares == pytest.approx({0.0: 0.67, 1.0: 0.33}, abs=0.005)
    given = class_mass_normalization(df, 2, [0.5, 0.5], scores="scores").orderBy("index").collect()
    assert [r["scores"] for r in given] == [[a / 2, b / 2] for _, _, (a, b) in PRIOR_ROWS]
    found = class_mass_normalization(df, 2, scores="scores").orderBy("index").collect()
    assert found[0]["scores"] == pytest.approx([0.0, 1 / 3])
    with pytest.raises(ValueError):
        class_mass_normalization(df, 2, [0.5, 0.6])
    with pytest.raises(ValueError):
        class_mass_normalization(df, 3, [0.5, 0.5])


@pytest.mark.parametrize("unknown", [0.5, 0.25])
def test_label_rows(spark, unknown):
    labels = [0.0, 1.0, 2.0, 3.0, 0.0, None, math.nan]
    df = spark.createDataFrame(list(enumerate(labels)), "id bigint, label double")
    rows = {r["id"]: r["scores"] for r in label_matrix(df, unknown=unknown).collect()}
    for i in range(5):
        assert rows[i] == [float(c == labels[i]) for c in range(4)]
    assert rows[5] == rows[6] == [unknown] * 4


def test_mirrored_has_the_diagonal_once(edges):
    assert mirrored(edges).count() == 16


def brute_edges(x, sigma, tol):
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / sigma**2)
    return {(i, j): w[i, j] for i in range(len(x)) for j in range(i + 1) if w[i, j] > tol}


def edges_and_pairs(spark, x, sigma, tol, block_rows):
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    found = similarity_edges(df, "id", "v", sigma, tol, False, block_rows).collect()
    met = {(r["_c0"], r["_from"], r["c0"], r["_block"]) for r in block_pairs(df, "id", "v", sigma, tol, False, block_rows).collect()}
    blocks = {p[:2] for p in met} | {p[2:] for p in met}
    return {(r["src"], r["dst"]): r["weight"] for r in found}, len(met), len(blocks)


@pytest.mark.parametrize("copies", [1, 40])
def test_pivots_leave_out_far_cells_and_no_edge(spark, copies):
    """Clusters on a sphere in 24 dimensions, no axis of which is two radii wide."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 24))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    x = np.repeat(middles, 25, axis=0) + rng.normal(scale=0.01, size=(500, 24))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    got, met, blocks = edges_and_pairs(spark, x, 0.4, 0.01, 16)
    want = brute_edges(x, 0.4, 0.01)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(w) for k, w in want.items())
    print(met, blocks)
    assert blocks > 20 and met < 0.2 * blocks * (blocks + 1) / 2


def test_embeddings_by_label_meet_their_own_label_alone(spark):
    """Embeddings with their label as ten more features: most pairs of blocks are left out."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[*r.embedding, *(2.5 * (r.label == k) for k in range(10))] for r in rows], float)
    got, met, blocks = edges_and_pairs(spark, x, 0.6, 0.01, 16)
    want = brute_edges(x, 0.6, 0.01)
    assert got.keys() == want.keys()
    print(met, blocks)
    assert met < 0.3 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_few_rows_and_one_point(spark, n):
    df = spark.createDataFrame([(i, [1.0] * 5) for i in range(n)] + [(None, [2.0] * 5), (99, [None] * 5)], "id long, v array<double>")
    found = similarity_edges(df, "id", "v", 0.5, 0.01, False).collect()
    assert {(r.src, r.dst, r.weight) for r in found} == {(i, j, 1.0) for i in range(n) for j in range(i + 1)}
