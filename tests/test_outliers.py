"""Golden values of the clustered points, and histogram invariants."""

import pytest
from pyspark.sql import functions as F

from strayline.operators.outliers import (
    add_distance,
    boundary_histogram,
    cluster_bounds,
    cluster_report,
    cluster_summary,
    detect_outliers,
    distance_histogram,
    flag_outliers,
    group_centers,
    measure,
    report_pages,
    report_with_histogram,
)

CENTERS = {0: [1.0, 1.0], 1: [5.0, 5.0], 2: [30.0, 30.0]}
POINTS = [
    (0, [1, 2], 1, 0), (0, [2, 1], 1, 0), (0, [0, 1], 1, 0), (0, [1, 0], 1, 0),
    (0, [1, -1], 2, 0), (0, [4, 5], 5, 1), (1, [5, 6], 1, 0), (2, [20, 30], 10, 0),
    (1, [5, 7], 2, 0), (1, [5, 10], 5, 0),
]


@pytest.fixture(scope="module")
def points(spark):
    rows = [
        (i, c, [float(x) for x in p], CENTERS[c], float(d), o)
        for i, (c, p, d, o) in enumerate(POINTS)
    ]
    return spark.createDataFrame(
        rows,
        "id int, prediction int, point array<double>, centers array<double>, want_d double, want_o int",
    )


@pytest.mark.parametrize("width", [None, 2])
def test_distances_and_flags(points, width):
    found = detect_outliers(points, point="point", width=width).collect()
    assert all(r["distance"] == pytest.approx(r["want_d"]) for r in found)
    assert all(r["is_outlier"] == r["want_o"] for r in found)
    assert {r["prediction"] for r in found} == {1, 2, 3}
    assert len({r["rowId"] for r in found}) == len(POINTS)


def test_boundaries(points):
    bounds = cluster_bounds(add_distance(points, "point"))
    found = {r["prediction"]: r["computed_boundary"] for r in bounds.collect()}
    assert found == pytest.approx({0: 4.758321, 1: 6.066013, 2: 10.0}, abs=1e-6)


def test_summary_and_report(points):
    flagged = flag_outliers(add_distance(points, "point"))
    summary = {
        r["prediction"]: (r["count"], r["outlier_count"], r["outlier_percentage"])
        for r in cluster_summary(flagged).collect()
    }
    assert summary == {0: (6, 1, 17.0), 1: (3, 0, 0.0), 2: (1, 0, 0.0)}
    report = {r["prediction"]: r["percentage_outlier"] for r in cluster_report(flagged).collect()}
    assert report == {0: 16.667, 1: 0.0, 2: 0.0}


def test_null_cluster_is_kept(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "prediction int, distance double")
    assert flag_outliers(rows).count() == 3


def test_histograms_hold_every_row(points):
    flagged = flag_outliers(add_distance(points, "point"))
    for histogram in (distance_histogram(flagged, 7), boundary_histogram(flagged, 7)):
        totals = {r["prediction"]: r["n"] for r in histogram.groupBy("prediction").agg(F.sum("n").alias("n")).collect()}
        assert totals == {0: 6, 1: 3, 2: 1}
        assert histogram.count() == 21


def test_bucket_edges_are_exact(spark):
    """Distances on the edges themselves go to the lower bucket."""
    edges = [(1, 0.1 * i) for i in range(1, 11)] + [(1, 0.0)]
    rows = spark.createDataFrame(edges, "prediction int, distance double").withColumn(
        "computed_boundary", F.lit(0.85)
    )
    width = max(d for _, d in edges) / 10

    def bucket(d):
        for i in range(10):
            if width * i < d <= width * (i + 1) or (i == 0 and d == 0) or i == 9:
                return i

    want = [0] * 10
    for _, d in edges:
        want[bucket(d)] += 1
    found = distance_histogram(rows, 10).orderBy("bucket").collect()
    assert [r["n"] for r in found] == want
    assert sum(r["n_outlier"] for r in found) == 2


def test_one_point_cluster_goes_to_the_first_bucket(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0)], "prediction int, distance double, computed_boundary double")
    found = distance_histogram(rows, 4).filter("n > 0").collect()
    assert [(r["bucket"], r["n"]) for r in found] == [(0, 1)]


def test_pages_keep_every_row(points):
    flagged = flag_outliers(add_distance(points, "point"))
    pages = report_pages(flagged, ["id", "point"], "id", page_rows=2)
    assert pages.select(F.max(F.size("data_points"))).first()[0] < 6
    ids = [r["id"] for r in pages.select(F.inline("data_points")).collect()]
    assert sorted(ids) == list(range(10))


def test_report_columns(points):
    report = report_with_histogram(flag_outliers(add_distance(points, "point")))
    assert set(report.columns) == {
        "prediction", "amount", "amount_outlier", "percentage_outlier", "buckets",
    }


def test_group_centers(points):
    found = {r["prediction"]: r["centers"] for r in group_centers(points, "prediction", "point").collect()}
    assert found[1] == pytest.approx([5.0, 23 / 3])


def test_reports_of_one_distance_table(points):
    """The shared table gives what the separate operators give."""
    table = measure(points, ["id"], point="point", width=2)
    flagged = detect_outliers(points, point="point", row_id=None)
    assert sorted(table.rows.columns) == ["distance", "id", "prediction"]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(table.flagged().select("id", "prediction", "distance", "computed_boundary", "is_outlier"), flagged)
    assert same(table.report(), cluster_report(flagged)) and same(table.summary(), cluster_summary(flagged))
    for n in (1, 7):
        assert same(table.histogram(n), distance_histogram(flagged, n))
        assert same(table.boundary_histogram(n), boundary_histogram(flagged, n))
    empty = measure(points.filter("id < 0"), ["id"], point="point", width=2)
    assert empty.flagged().count() == empty.histogram().count() == empty.boundary_histogram().count() == 0
