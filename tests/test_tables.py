"""Casts, scaling, sources, generated tables, sampling, durations, logs and metrics."""

import math
from pathlib import Path

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strayline import lineage
from strayline.functions import durations
from strayline.operators import logs
from strayline.operators.classification import equidistant_values, make_grid, make_pipeline
from strayline.operators.clustering import nearest_center
from strayline.operators.features import CastColumn, DenseVector, cast_column, fit_scaler, split_known
from strayline.operators.metrics import (
    area_under_roc,
    confusion_matrix,
    error_counts,
    error_rate,
    threshold_curve,
)
from strayline.operators.row_ids import add_dense_id
from strayline.operators.sampling import enlarge, hash_split, hide_labels, shrink
from strayline.roles import Roles
from strayline.sources import readers, synthetic, writers


def test_roles_flatten_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id int, label string, f double")
    assert Roles.from_columns(df, "id", ["label"]).features == ("f",)
    assert Roles.of("id", "label", ["f"]).columns == ["id", "label", "f"]


def test_casts(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    assert [r["a"] for r in cast_column(df, "a", "int").collect()] == [1, None]
    with pytest.raises(TypeError):
        cast_column(df, "a", "boolean")
    with pytest.raises(TypeError):
        CastColumn(inputCol="a", castTo="date")


def test_transformers_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "a int, v array<double>").withColumn("v", array_to_vector("v"))
    stages = [CastColumn(inputCol="a", castTo="double"), DenseVector(inputCol="v", outputCol="d")]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert dict(model.transform(df).dtypes)["a"] == "double"


@pytest.mark.parametrize("n", [2, 20])
def test_scaler(spark, n):
    rows = [tuple(float(i * (j + 1)) for j in range(n - 1)) + (5.0,) for i in range(5)]
    names = [f"f{j}" for j in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    scaled = df.select(fit_scaler(df, names).vector().alias("v")).collect()
    deviation = math.sqrt(2.5)
    for i, r in enumerate(scaled):
        assert r["v"][:-1] == pytest.approx([(i - 2) / deviation] * (n - 1))
        assert r["v"][-1] == 0.0


def test_known_split(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,)], "label double")
    known, unknown = split_known(df, "label")
    assert (known.count(), unknown.count()) == (1, 2)


def test_read_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "f_1 int, f_2 int")
    writers.write_csv(df, str(tmp_path / "t.csv"))
    read = readers.read_any(spark, str(tmp_path / "t.csv"))
    assert dict(read.dtypes) == {"f_1": "string", "f_2": "string"}
    assert sorted((int(r[0]), int(r[1])) for r in read.collect()) == [(1, 2), (3, 4), (5, 6)]
    assert readers.extension_of("/home/a/works.pace/data/test.csv") == ".csv"
    with pytest.raises(ValueError):
        readers.extension_of("/home/a/test")


def test_corrupt_records_are_kept(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,label\n1,nan\nx,2.5\n2,NaN\n3,1.5\n")
    schema = "id int, label double"
    from pyspark.sql.types import _parse_datatype_string

    read = readers.read_csv_with_missing(
        spark, str(tmp_path / "t.csv"), _parse_datatype_string(schema), corrupt_column="_bad"
    ).cache()
    rows = {r["id"]: r for r in read.collect()}
    assert rows[1]["label"] is None and math.isnan(rows[2]["label"]) and rows[3]["label"] == 1.5
    assert rows[None]["_bad"] == "x,2.5"


def test_generated_tables(spark):
    clusters = synthetic.gaussian_clusters(spark, [10, 3, 27], [[i * 10.0] * 10 for i in range(3)])
    assert (clusters.count(), len(clusters.columns)) == (40, 12)
    assert [r["count"] for r in clusters.groupBy("k").count().orderBy("k").collect()] == [10, 3, 27]

    helix = synthetic.double_helix(spark, 50, 2.0, 1.0, 0.1)
    assert helix.count() == 100
    kept = helix.filter("NOT isnan(unknown_label)").groupBy("unknown_label").count().collect()
    assert sorted((r[0], r[1]) for r in kept) == [(0.0, 5), (1.0, 5)]
    assert helix.filter("abs(x * x + y * y - 4) > 1e-9").count() == 0

    springs = synthetic.springs(spark, 2.5, [(0, 3, 10), (0, -3, 10)], draws=1)
    assert springs.count() == 20
    assert springs.filter("NOT isnan(label)").count() == 2
    last = springs.filter("id = 19").first()["vector"]
    assert last == pytest.approx([2.5 * math.sin(-3), 2.5 * math.cos(-3), -3.0])


def test_dense_ids(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") % 3).filter("id % 5 != 0")
    found = add_dense_id(df.drop("id"), "n")
    assert sorted(r["n"] for r in found.collect()) == list(range(800))
    ordered = add_dense_id(df, "n", ["k", "id"]).orderBy("n").collect()
    assert [(r["k"], r["id"]) for r in ordered] == sorted((r["k"], r["id"]) for r in ordered)
    assert add_dense_id(df.filter("id < 0"), "n").count() == 0


def test_resizing(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).alias("label"), F.lit(1.0).alias("f"))
    assert enlarge(df, 6000, ["f"], 1).count() == pytest.approx(6000, rel=0.05)
    assert shrink(df, 1000, "label", "id", 1).count() == pytest.approx(1000, rel=0.08)
    few = shrink(df, 2, "label", "id", 1)
    assert few.select("label").distinct().count() == 10


def test_hidden_labels(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("label"))
    masked = hide_labels(df, "label", per_label={0: 0.2, 1: 0.6}).cache()
    assert {"id", "missing_label"} <= set(masked.columns)
    kept = {r[0]: r[1] for r in masked.filter("NOT isnan(missing_label)").groupBy("label").count().collect()}
    assert kept[0] == pytest.approx(500, rel=0.15)
    assert kept[1] == pytest.approx(1500, rel=0.1)


def test_hash_split_is_whole_and_stable(spark):
    df = spark.range(1000)
    train, test = hash_split(df, "id", 0.8, 1)
    again, _ = hash_split(df.repartition(13), "id", 0.8, 1)
    assert train.count() + test.count() == 1000
    assert {r[0] for r in train.collect()} == {r[0] for r in again.collect()}


@pytest.mark.parametrize(
    "text,seconds",
    [("1 h", 3600), ("1 h 23 min", 4980), ("32 h 33 min 59 s", 117239), ("1min 2s", 62),
     ("321 ms", 0.321), ("5 µs", 5e-6), ("2 d", 172800), ("3 weeks", None), ("soon", None)],
)
def test_durations(spark, text, seconds):
    found = spark.createDataFrame([(text,)], "t string").select(durations.to_seconds("t")).first()[0]
    assert found == (None if seconds is None else pytest.approx(seconds))


@pytest.mark.parametrize(
    "seconds,text",
    [(117239.0, "1d 8h 33min 59s"), (3600.0, "1h"), (60.0, "1min"), (59.5, "59.5 s"), (0.321, "321 ms"),
     (1.5, "1.5 s"), (0.0000123, "12.3 µs"), (5e-9, "5 ns"), (0.0, "0 ns"), (0.9999, "1e+03 ms"), (10.0, "10 s")],
)
def test_readable_durations(spark, seconds, text):
    found = spark.createDataFrame([(seconds,)], "s double").select(durations.to_text("s")).first()[0]
    assert found == text


def test_log_lines(spark):
    head = "2017-09-05 14:18:08,123:INFO:__main__:"
    lines = [
        head + "Iteration: 0 - Number of partions: 80",
        head + "Iteration: 0 - data: rows_1000.parquet",
        head + "Iteration: 0 - Training model time: 1min 2s +- 321 ms per loop",
        head + "no parts here",
        "not a log line",
    ]
    records = logs.split_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert records.count() == 3
    row = logs.timings(records).first()
    assert (row["mean"], row["std"], row["n"], row["partitions"]) == (62.0, 0.321, 1000, 80)
    assert row["type"] == "INFO" and row["ts"].microsecond == 123000


def test_errors_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 0)], "a int, b int")
    assert error_rate(df, "a", "b").first()[0] == 0.5
    assert tuple(error_counts(df, "a", "b").first()) == (4, 2, 0.5)
    with pytest.raises(ValueError):
        confusion_matrix(df, "a", "c")


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_curve_against_brute_force(spark, slices):
    rows = [(i % 3 == 0, ((i * 37) % 50) / 50) for i in range(200)]
    df = spark.createDataFrame([(int(a), b) for a, b in rows], "y int, s double")
    positives = [s for y, s in rows if y]
    negatives = [s for y, s in rows if not y]
    found = threshold_curve(df, "y", "s", slices).collect()
    assert len(found) == 50
    for r in found:
        assert r["tp"] == sum(s >= r["threshold"] for s in positives)
        assert r["fp"] == sum(s >= r["threshold"] for s in negatives)
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    area = area_under_roc(df, "y", "s", slices).first()[0]
    assert area == pytest.approx(wins / len(positives) / len(negatives))


def test_grid():
    assert equidistant_values({"a": (1, 10), "b": (0.0, 1.0), "c": 3}) == {"a": [1, 5, 10], "b": [0.0, 0.5, 1.0]}


def test_parameter_maps(spark):
    model = make_pipeline(["a"], "y", maxIter=(1, 10), regParam=0.1).getStages()[-1]
    assert model.getRegParam() == 0.1 and model.getMaxIter() == 100
    maps = make_grid(model, {"maxIter": (1, 10), "regParam": 0.1, "elasticNetParam": [0.0, 1.0]})
    assert len(maps) == 6 and all(m[model.regParam] == 0.1 for m in maps)


@pytest.mark.parametrize("width", [2, 40])
def test_nearest_center_takes_the_lowest_on_ties(spark, width):
    centers = [[0.0] * width, [2.0] * width, [2.0] * width, [9.0] * width, [4.0] * width]
    rows = [([1.0] * width,), ([2.1] * width,), ([8.0] * width,), (None,)]
    df = spark.createDataFrame(rows, "p array<double>")
    assert [r["prediction"] for r in nearest_center(df, centers, "p").collect()][:3] == [0, 1, 3]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


@pytest.mark.parametrize("range_lines", [100_000, 7])
def test_runs_of_one_iteration_are_told_apart(spark, monkeypatch, range_lines):
    """Iteration 0 begins anew in a third of the lines; one range or many, each run keeps its own records."""
    monkeypatch.setattr(logs, "RANGE_LINES", range_lines)
    lines, want = [], []
    for k in range(60):
        i = 0 if k % 3 == 0 else k
        head = f"2021-03-04 05:{k:02}:00,000:INFO:main:Iteration: {i} - "
        kinds = [f"Number of partions: {k}", f"data: rows_{1000 + k}", f"Training model time: {k}min 1s ± 2 ms per loop"]
        if k == 9:
            kinds = kinds[:2]  # a run that was broken off
        lines += [head + x for x in kinds] + [head + "finished"]
        if k != 9:
            want.append((str(i), k, 1000 + k, 60.0 * k + 1, 0.002))
    lines.insert(0, "2021-03-04 04:00:00,000:INFO:main:Iteration: 0 - data: rows_1")  # of a run that began before the log
    lines.append("2021-03-04 06:00:00,000:INFO:main:Iteration: 1 - data: rows_7")  # the last of a kind holds
    want[want.index(next(w for w in want if w[0] == "1"))] = ("1", 1, 7, 61.0, 0.002)
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    for records in (logs.timing_records(df), logs.split_lines(df)):
        found = logs.timings(records).collect()
        assert sorted((r.Iteration, r.partitions, r.n, r["mean"], r["std"]) for r in found) == sorted(want)
        assert {(r.type, r.function) for r in found} == {("INFO", "main")}


def test_records_of_odd_lines(spark):
    head = "2021-03-04 05:06:07,008:INFO:main:"
    lines = [None, "", "no log line", head + "Iteration: 4", head + "Iteration: 4 - free - data: 3", head + "a: 1 - data: 3",
             head + "Iteration: 5 - data: none", head + "Iteration: 5 - data: 1 - data: 22", head + " Iteration : 6 - x: 1 - Number of partions : p8"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = {(r.Iteration, r._has_data, r.n, r.partitions) for r in logs.timing_records(df).collect()}
    assert found == {("5", True, None, None), ("5", True, 22, None), ("6", False, None, 8)}
    assert logs.timings(logs.timing_records(df)).count() == 0
    assert logs.timings(logs.timing_records(df.limit(0))).count() == 0


def test_tables_of_a_job_go_with_it(spark):
    def files(path):
        return len(list(Path(path.removeprefix("file:")).glob("part-*"))) if Path(path.removeprefix("file:")).exists() else 0

    with lineage.job(spark) as outer:
        with lineage.job(spark) as inner:
            lost = lineage.cut(spark.range(5))
            kept = inner.keep(lost.withColumn("x", F.lit(1)))
            paths = [t.inputFiles()[0].rsplit("/", 1)[0] for t in (lost, kept)]
            assert all(files(p) for p in paths)
        assert not files(paths[0]) and files(paths[1]) and kept.count() == 5
        last = outer.keep(kept)
    assert not files(paths[1]) and last.count() == 5
    with pytest.raises(ValueError), lineage.job(spark):
        lineage.cut(spark.range(1))
        raise ValueError
    assert lineage._JOBS == []
