"""Models against MLlib, numpy and themselves: regression, mixtures, centers, folds."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strayline.operators import classification as classifying
from strayline.operators import clustering, generative, lloyd, mixture, moments, newton, topics
from strayline.operators.features import fit_scaler
from strayline.operators.outliers import group_centers
from strayline.plans import classification
from strayline.roles import Roles


def labelled(spark, n=600, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * ([1.0, 50.0, 0.01, 3.0, 2.0] * d)[:d] + 7
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = (rng.random(n) < 1 / (1 + np.exp(-(z @ np.linspace(-1.5, 2, d) + 0.4)))).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    names = [f"f{i}" for i in range(d)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in names) + ", y double"), names


@pytest.mark.parametrize("r", [0.0, 0.05])
def test_newton_agrees_with_mllib(spark, r):
    df, names = labelled(spark)
    ours, intercept = newton.fit_logistic(df, names, "y", (r,), steps=20)[0].coefficients()
    rows = df.select(array_to_vector(F.array(*names)).alias("features"), "y")
    theirs = LogisticRegression(labelCol="y", regParam=r, maxIter=500, tol=1e-12).fit(rows)
    assert ours == pytest.approx(theirs.coefficients.toArray().tolist(), rel=1e-4, abs=1e-4)
    assert intercept == pytest.approx(theirs.intercept, rel=1e-4, abs=1e-3)
    scored = newton.scored(df, newton.fit_logistic(df, names, "y", (r,), steps=20)[0])
    p = {row.id: row.probability[1] for row in scored.collect()}
    q = theirs.transform(df.select("id", array_to_vector(F.array(*names)).alias("features"), "y"))
    for row in q.select("id", vector_to_array("probability").alias("p"), "prediction").collect():
        assert p[row.id] == pytest.approx(row.p[1], abs=1e-4)


def test_newton_with_unknown_and_constant_values(spark):
    df, names = labelled(spark, 200, 2)
    odd = df.selectExpr("id", "f0", "f1", "7.0 AS flat", "y").union(
        spark.createDataFrame(
            [(900, None, 1.0, 7.0, 1.0), (901, math.nan, 1.0, 7.0, 1.0), (902, 7.0, 7.0, 7.0, None), (903, 7.0, 7.0, 7.0, math.nan)],
            "id long, f0 double, f1 double, flat double, y double",
        )
    )
    model = newton.fit_logistic(odd, [*names, "flat"], "y", steps=20)[0]
    assert model.weights[2] == 0.0 and np.isfinite(model.weights).all()
    out = {r.id: r.prediction for r in newton.scored(odd, model).collect()}
    assert out[900] is None and out[902] in (0.0, 1.0)
    with pytest.raises(ValueError, match="0 or 1"):
        newton.fit_logistic(df.withColumn("y", F.col("y") + 1), names, "y")
    empty = newton.fit_logistic(df.filter("id < 0"), names, "y")[0]
    assert empty.weights.tolist() == [0.0] * 3


def test_a_separable_label_does_not_break_the_steps(spark):
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id >= 37 AS DOUBLE) AS y")
    model = newton.fit_logistic(df, ["x"], "y", steps=30)[0]
    assert all(r.prediction == r.y for r in newton.scored(df, model).collect())


def test_folds_do_not_hang_on_partitioning(spark):
    df, names = labelled(spark, 500, 3)
    found = []
    for n in (3, 50):
        _, scores = newton.cross_validated(df.repartition(n), names, "y", ["id"], (0.01, 0.5), 3, seed=2)
        measures = newton.fold_measures(scores, "y").orderBy("regularisation", "fold").collect()
        assert [r.n for r in measures[:3]] == [r.n for r in measures[3:]]
        assert sum(r.n for r in measures) == 1000 and len(measures) == 6
        found.append([(r.regularisation, r.fold, r.n, round(r.log_loss, 9), r.accuracy) for r in measures])
        assert newton.best_regularisation(newton.fold_measures(scores, "y")) == 0.01
    assert found[0] == found[1]
    # The measure of one fold again, from a model fitted on the others alone.
    fold = newton.fold_number(["id"], 3, 2)
    others, held = df.filter(fold != 0), df.filter(fold == 0)
    scaler = fit_scaler(df, names)
    x, y = (np.array([list(r.v) for r in t.select(scaler.vector().alias("v")).collect()]) for t in (others, held))
    t, u = (np.array([r.y for r in s.collect()]) for s in (others, held))
    w = np.zeros(4)
    x1, y1 = np.c_[x, np.ones(len(x))], np.c_[y, np.ones(len(y))]
    ridge = np.diag([0.01] * 3 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x1 @ w))
        w = w + np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 / len(x) + ridge, x1.T @ (t - p) / len(x) - ridge @ w)
    p = 1 / (1 + np.exp(-y1 @ w))
    assert found[0][0][3] == pytest.approx(-(u * np.log(p) + (1 - u) * np.log(1 - p)).mean(), abs=1e-7)


def test_passes_do_not_grow_with_the_grid(spark, monkeypatch):
    df, names = labelled(spark, 200, 2)
    counted = []
    real = moments.total
    for module in (newton, lloyd):
        monkeypatch.setattr(module, "total", lambda *a, real=real: counted.append(1) or real(*a))
    passes = []
    for grid in ((0.1,), (0.1, 0.2, 0.3, 0.4)):
        counted.clear()
        newton.fit_logistic(df, names, "y", grid, steps=3)
        passes.append(len(counted))
    assert passes == [4, 4]
    rows = df.select(F.array(*names).alias("v"))
    start = [r.v for r in rows.limit(5).collect()]
    for ks in ((2,), (2, 3, 4, 5)):
        counted.clear()
        assert lloyd.sweep_centers(rows, "v", start, ks, (2, 4)).count() == 2 * len(ks)
        assert len(counted) == 4 + 2


def test_the_job_by_newton_steps(spark):
    df, names = labelled(spark)
    found = classification.run(df, Roles.of("id", "y", names), "newton", seed=3)
    again = classification.run(df.repartition(9), Roles.of("id", "y", names), "newton", seed=3)
    key = lambda r: r.id
    one, other = sorted(found.collect(), key=key), sorted(again.collect(), key=key)
    assert found.columns == ["id", *names, "y", "rawPrediction", "probability", "prediction"]
    assert [r.id for r in one] == [r.id for r in other] and 80 < len(one) < 160
    assert np.mean([r.prediction == r.y for r in one]) > 0.75
    for r, s in zip(one, other):
        assert r.probability == pytest.approx(s.probability, abs=1e-9) and r.rawPrediction[0] == -r.rawPrediction[1]


def test_checked_baseline_learns_from_known_labels_alone(spark):
    df, names = labelled(spark)
    half = df.withColumn("known", F.when(F.col("id") % 2 == 0, F.col("y")))
    out = generative.checked_baseline(half, names, "known", ["id"]).collect()
    wrong = generative.checked_baseline(half.withColumn("y", 1 - F.col("y")), names, "known", ["id"]).collect()
    assert len(out) == 600 and [r.prediction for r in out] == [r.prediction for r in wrong]
    assert np.mean([r.prediction == r.y for r in out if r.known is None]) > 0.75


def blobs(spark, d=2, n=400, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(3, d)) * 6
    own = rng.integers(0, 3, n)
    x = middles[own] + rng.normal(size=(n, d)) @ (np.eye(d) + 0.3)
    return spark.createDataFrame([(i, r.tolist(), int(g)) for i, (r, g) in enumerate(zip(x, own))], "id int, v array<double>, g int"), x, own


def em_by_hand(x, w, m, c):
    dens = np.stack(
        [wk * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - mk, np.linalg.inv(ck), x - mk)) / np.sqrt(np.linalg.det(2 * np.pi * ck)) for wk, mk, ck in zip(w, m, c)],
        axis=1,
    )
    r = dens / dens.sum(axis=1, keepdims=True)
    n = r.sum(axis=0)
    m2 = (r.T @ x) / n[:, None]
    c2 = [np.einsum("i,ij,ik->jk", r[:, k], x - m2[k], x - m2[k]) / n[k] for k in range(len(n))]
    return n / n.sum(), m2, np.array(c2), np.log(dens.sum(axis=1)).mean()


@pytest.mark.parametrize("d", [1, 2, 6])
def test_a_mixture_step_by_hand(spark, d):
    df, x, own = blobs(spark, d)
    start = mixture.grouped_components(df, "v", F.col("g"), 3)
    assert start.means == pytest.approx(np.array([x[own == k].mean(axis=0) for k in range(3)]))
    assert start.covariances == pytest.approx(np.array([np.cov(x[own == k].T, bias=True).reshape(d, d) for k in range(3)]))
    after, score = mixture.mixture_step(df, "v", start)
    w, m, c, want = em_by_hand(x, start.weights, start.means, start.covariances)
    assert after.weights == pytest.approx(w) and after.means == pytest.approx(m)
    assert after.covariances == pytest.approx(c) and score == pytest.approx(want)


def test_a_model_of_mllib_is_a_fixed_point(spark):
    df, _, _ = blobs(spark)
    rows = df.withColumn("features", array_to_vector("v"))
    model = GaussianMixture(k=3, seed=1, maxIter=400, tol=1e-13).fit(rows)
    parts = mixture.Components.of_model(model)
    after, _ = mixture.mixture_step(df, "v", parts)
    assert after.weights == pytest.approx(parts.weights, abs=1e-6)
    assert after.means == pytest.approx(parts.means, abs=1e-6)
    assert after.covariances == pytest.approx(parts.covariances, abs=1e-6)
    theirs = {r.id: (r.prediction, r.p) for r in model.transform(rows).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    for r in mixture.apply_mixture(df, "v", parts).collect():
        assert r.prediction == theirs[r.id][0] and r.probability == pytest.approx(theirs[r.id][1], abs=1e-6)


def test_fit_mixture_finds_the_blobs_and_odd_rows(spark):
    df, x, own = blobs(spark)
    odd = df.union(spark.createDataFrame([(900, None, 0), (901, [None, 1.0], 0), (902, [math.nan, 1.0], 1)], df.schema))
    start = mixture.grouped_components(odd, "v", F.col("id") % 3, 3)
    start.means = x[[int(np.flatnonzero(own == k)[0]) for k in range(3)]].copy()
    found = mixture.fit_mixture(odd, "v", start)
    assert found.weights.sum() == pytest.approx(1.0)
    assert np.sort(found.means[:, 0]) == pytest.approx(np.sort([x[own == k].mean(axis=0)[0] for k in range(3)]), abs=0.3)
    out = {r.id: r for r in mixture.apply_mixture(odd, "v", found).collect()}
    assert all(out[i].prediction is None and out[i].probability is None for i in (900, 901, 902))
    nothing, score = mixture.mixture_step(df.filter("id < 0"), "v", found)
    assert nothing is found and math.isnan(score)
    flat = spark.createDataFrame([(i, [float(i % 2), 1.0], 0) for i in range(10)], df.schema)
    after, score = mixture.mixture_step(flat, "v", mixture.grouped_components(flat, "v", F.lit(0), 1))
    assert after.means.tolist() == [[0.5, 1.0]] and np.isfinite(score)


def test_lloyd_steps_by_hand_and_an_empty_cluster(spark):
    df, x, _ = blobs(spark)
    start = np.concatenate([x[:3], [[1e6, 1e6]]])
    path = lloyd.lloyd_steps(df.repartition(5), "v", {"a": start.tolist(), "b": start[:2].tolist()}, 6)
    for name in ("a", "b"):
        centers = start[: 4 if name == "a" else 2].copy()
        for step in range(6):
            own = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(axis=1)
            cost = ((x - centers[own]) ** 2).sum()
            centers = np.array([x[own == k].mean(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
            got = path[step][name]
            assert got.centers == pytest.approx(centers) and got.cost == pytest.approx(cost)
            assert got.sizes.tolist() == np.bincount(own, minlength=len(centers)).tolist()
    assert path[-1]["a"].centers[3].tolist() == [1e6, 1e6] and path[-1]["a"].sizes[3] == 0


def test_scores_and_fixed_point_against_mllib(spark):
    df, x, _ = blobs(spark)
    rows = df.withColumn("features", array_to_vector("v"))
    model = KMeans(k=3, seed=4, maxIter=200, tol=0.0).fit(rows)
    centers = np.array([c.tolist() for c in model.clusterCenters()])
    after = lloyd.lloyd_steps(df, "v", {0: centers}, 1)[0][0]
    assert after.centers == pytest.approx(centers, abs=1e-9)
    silhouette, cost = lloyd.model_scores(df, "v", {0: centers})[0]
    assert silhouette == pytest.approx(ClusteringEvaluator().evaluate(model.transform(rows)), abs=1e-9)
    assert cost == pytest.approx(model.summary.trainingCost)


@pytest.mark.parametrize("width", [3, 200])
def test_vector_moments(spark, width):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1.0, size=(90, width))
    x[4, 0] = np.nan
    rows = [(i, None if i % 3 == 2 else i % 3, [None if np.isnan(e) else float(e) for e in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (99, 1, None)], "id int, g int, v array<double>").repartition(4)
    for by, groups in ((None, [(None, np.arange(90))]), ("g", [(g, np.array([i for i, k, _ in rows if k == g])) for g in (0, 1, None)])):
        found = moments.vector_moments(df, "v", by).collect()
        assert len(found) == width * len(groups)
        for g, own in groups:
            for r in found:
                if by and r.g != g:
                    continue
                e = x[own, r.position]
                e = e[~np.isnan(e)]
                assert r.known == len(e) and r["mean"] == pytest.approx(e.mean(), rel=1e-12)
                assert r.deviations == pytest.approx(((e - e.mean()) ** 2).sum(), rel=1e-8)
                assert (r.low, r.high) == (e.min(), e.max())
    centers = {r.g: r.centers for r in group_centers(df.filter("id <> 4"), "g", "v").collect()}
    for g, own in groups:
        assert centers[g] == pytest.approx(x[own[own != 4]].mean(axis=0).tolist())


def test_wide_scaler_and_uneven_vectors(spark):
    rows = [(float(i),) * 40 for i in range(5)]
    df = spark.createDataFrame([(list(r),) for r in rows], "v array<double>")
    scaler = fit_scaler(df, "v")
    assert scaler.means == pytest.approx([2.0] * 40) and scaler.stds == pytest.approx([2.5**0.5] * 40) and scaler.rows == 5
    uneven = df.union(spark.createDataFrame([([1.0],)], "v array<double>"))
    for job in (lambda: fit_scaler(uneven, "v"), lambda: group_centers(uneven.withColumn("g", F.lit(1)), "g", "v").collect()):
        with pytest.raises(Exception, match="dimensions"):
            job()


def test_two_planted_topics_are_told_apart(spark):
    rng = np.random.default_rng(6)
    vocabulary = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = []
    for i in range(120):
        own = list(rng.choice(vocabulary[i % 2], 30)) + ["The", "the"] * 5  # a word all texts have
        rows.append((i, " ".join(rng.permutation(own))))
    rows += [(200, None), (201, ""), (202, " \t"), (None, "a1 a2")]
    df = spark.createDataFrame(rows, "id long, text string")
    for hot in (1_000_000, 50):
        of_doc, of_word = topics.topic_steps(topics.word_counts(df.filter("id IS NOT NULL"), "id", "text"), 2, 12, seed=1, hot_rows=hot)
        sums = [r.topics for r in of_word.collect()]
        assert sum(map(sum, sums)) == pytest.approx(120 * 40) and len(sums) == 81
        found = {r.doc: r.topics for r in of_doc.collect()}
        assert all(sum(t) == pytest.approx(40) for t in found.values())
    out = {r.id: r for r in topics.table_topics(df, "id", "text", 2, 12, seed=1).collect()}
    even = {out[i].topic for i in range(0, 120, 2)}
    odd = {out[i].topic for i in range(1, 120, 2)}
    assert len(even) == len(odd) == 1 and even != odd
    assert all(out[i].topic is None and out[i].topic_weights is None for i in (200, 201, 202, None))
    assert all(sum(out[i].topic_weights) == pytest.approx(1.0) for i in range(120))
    assert topics.table_topics(df.limit(0), "id", "text", 2, 2).count() == 0


def test_clusters_by_steps_name_themselves(spark):
    df, x, own = blobs(spark)
    rows = df.filter("g < 2").withColumns({"a": F.get("v", F.lit(0)), "b": F.get("v", F.lit(1))})
    known = F.when(F.col("id") % 5 == 0, F.col("g").cast("double") + 4)
    given = rows.withColumn("known", known).select("id", "g", "a", "b", "known")
    scaler = fit_scaler(given, ["a", "b"])
    start = [(x[np.flatnonzero(own == k)[0]] - scaler.means) / scaler.stds for k in (1, 0)]
    odd = given.union(spark.createDataFrame([(999, 0, None, 1.0, None)], given.schema))
    out = generative.clusters_by_steps(odd, ["a", "b"], "known", start).collect()
    assert len(out) == rows.count() + 1
    for r in out:
        if r.id == 999:
            assert r.cluster is None and r.prediction is None and r.majority_label is None
    right = [r.majority_label == r.g + 4 and r.cluster == 1 - r.g for r in out if r.id != 999]
    assert np.mean(right) > 0.95
    with pytest.raises(ValueError, match="two"):
        generative.clusters_by_steps(given.withColumn("known", F.lit(1.0)), ["a", "b"], "known", start)


def test_mllib_sweep_scores_its_models(spark):
    df, x, _ = blobs(spark)
    rows = df.withColumn("_vector", array_to_vector("v"))
    found = {(r.k, r.max_iter): r for r in clustering.sweep(rows, "kmeans", (2, 3), (20,), seed=4).collect()}
    for k in (2, 3):
        model = KMeans(featuresCol="_vector", k=k, maxIter=20, seed=4).fit(rows)
        centers = np.array([c.tolist() for c in model.clusterCenters()])
        silhouette, _ = lloyd.model_scores(df, "v", {0: centers})[0]
        assert found[k, 20].silhouette == pytest.approx(silhouette, abs=1e-9)
        assert found[k, 20].training_score == pytest.approx(model.summary.trainingCost)
    assert found[3, 20].silhouette > found[2, 20].silhouette


def test_mllib_topics_are_told_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(12)], 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r.id: r for r in clustering.topics(df, "text", k=2, max_iter=30, seed=3).collect()}
    even, odd = ([out[i].topic for i in range(s, 60, 2)] for s in (0, 1))
    assert max(even.count(t) for t in (0, 1)) > 27 and max(odd.count(t) for t in (0, 1)) > 27
    assert max((0, 1), key=even.count) != max((0, 1), key=odd.count)
    assert all(sum(r.topic_weights) == pytest.approx(1.0) for r in out.values())


def test_mllib_cross_validation_prefers_the_better_model(spark):
    df, names = labelled(spark)
    pipeline = classifying.make_pipeline(names, "y", scale=True, maxIter=50)
    grid = classifying.make_grid(pipeline.getStages()[-1], {"regParam": [0.01, 1000.0]})
    model = classifying.cross_validate(pipeline, df, BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderPR"), grid, 3, seed=1)
    found = {r.params: r.avg_metric for r in classifying.fold_metrics(spark, model).collect()}
    assert len(found) == 2 and found["regParam=0.01"] >= found["regParam=1000.0"] - 1e-6 and found["regParam=0.01"] > 0.75
    ours = newton.fit_logistic(df, names, "y", (0.01,), steps=20)[0]
    p = {r.id: r.probability[1] for r in newton.scored(df, ours).collect()}
    best = model.bestModel.transform(df).select("id", vector_to_array("probability").alias("p")).collect()
    if model.bestModel.stages[-1].getRegParam() == 0.01:
        assert all(p[r.id] == pytest.approx(r.p[1], abs=1e-3) for r in best)
