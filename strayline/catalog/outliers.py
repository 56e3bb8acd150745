"""Outlier detection: distances, boundaries, reports and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayline.catalog.common import (
    FLAGGED_SQL,
    LINEITEM_FEATURES,
    LINEITEM_FLAGGED_SQL,
    VECTORS_SQL,
    WIDTH,
    centered,
    flagged,
    flagged_lineitem,
    measured_lineitem,
    query,
    table,
    vectors,
)
from strayline.lineage import cut
from strayline.operators.clustering import nearest_center, own_center_distance
from strayline.operators.features import fit_scaler
from strayline.operators.metrics import confusion_matrix, error_counts, error_rate
from strayline.operators.outliers import (
    add_distance,
    add_percentage_distance,
    attach_centers,
    boundary_histogram,
    boundary_profile,
    cluster_report,
    cluster_summary,
    distance_histogram,
    group_centers,
    outlier_ratio,
    report_pages,
    report_with_histogram,
)
from strayline.operators.row_ids import add_dense_id, add_row_id


@query(
    "f01_euclidean_distance",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, round(list_distance(v, c), 6) AS distance FROM e JOIN c USING (label)""",
)
def distances(spark, sf_dir):
    return add_distance(centered(spark, sf_dir), "point", width=WIDTH).select(
        "vec_id", F.round("distance", 6).alias("distance")
    )


@query(
    "f02_percentage_distance",
    "WITH " + FLAGGED_SQL + """
SELECT vec_id, round((max(distance) OVER (PARTITION BY prediction) - distance) / 100, 8) AS percentage_distance FROM f""",
)
def percentage(spark, sf_dir):
    return add_percentage_distance(flagged(spark, sf_dir)).select(
        "vec_id", F.round("percentage_distance", 8).alias("percentage_distance")
    )


@query(
    "w01_outlier_boundary",
    "WITH " + FLAGGED_SQL + """
SELECT vec_id, prediction, round(distance, 6) AS distance, round(computed_boundary, 6) AS computed_boundary, is_outlier FROM f""",
)
def boundaries(spark, sf_dir):
    return flagged(spark, sf_dir).select(
        "vec_id",
        "prediction",
        F.round("distance", 6).alias("distance"),
        F.round("computed_boundary", 6).alias("computed_boundary"),
        "is_outlier",
    )


@query(
    "w02_row_id",
    "SELECT count(*) AS n, count(*) AS n_distinct FROM lineitem",
)
def row_ids(spark, sf_dir):
    numbered = add_row_id(table(spark, sf_dir, "lineitem", "l_orderkey"))
    return numbered.agg(
        F.count("rowId").alias("n"), F.countDistinct("rowId").alias("n_distinct")
    )


@query(
    "w03_dense_row_id",
    """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer""",
)
def dense_row_ids(spark, sf_dir):
    return add_dense_id(
        table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), "id", ["c_acctbal", "c_custkey"]
    ).select("c_custkey", "id")


@query(
    "m07_outlier_workflow_lineitem",
    "WITH " + LINEITEM_FLAGGED_SQL + """
SELECT prediction, count(*) AS amount, CAST(sum(is_outlier) AS BIGINT) AS amount_outlier,
       round(100 * sum(is_outlier) / count(*), 3) AS percentage_outlier,
       round(max(computed_boundary), 6) AS boundary, round(avg(distance), 6) AS mean_distance
FROM f GROUP BY prediction""",
)
def outlier_workflow(spark, sf_dir):
    rows = flagged_lineitem(spark, sf_dir)
    detail = rows.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("amount"),
        F.sum("is_outlier").alias("amount_outlier"),
        F.round(F.max("computed_boundary"), 6).alias("boundary"),
        F.round(F.avg("distance"), 6).alias("mean_distance"),
    )
    share = F.round(100 * F.col("amount_outlier") / F.col("amount"), 3)
    return detail.withColumn("percentage_outlier", share)


@query(
    "m07_outlier_rows_lineitem",
    "WITH " + LINEITEM_FLAGGED_SQL + """
SELECT l_orderkey, prediction, round(distance, 6) AS distance, is_outlier FROM f""",
)
def outlier_rows(spark, sf_dir):
    return flagged_lineitem(spark, sf_dir).select(
        "l_orderkey", "prediction", F.round("distance", 6).alias("distance"), "is_outlier"
    )


_REPORT_SQL = """SELECT prediction, count(*) AS amount, CAST(sum(is_outlier) AS BIGINT) AS amount_outlier,
       round(100 * sum(is_outlier) / count(*), 3) AS percentage_outlier FROM f GROUP BY prediction"""


@query("a02_cluster_report", f"WITH {FLAGGED_SQL} {_REPORT_SQL}")
def report(spark, sf_dir):
    return cluster_report(flagged(spark, sf_dir))


@query("o01_sorted_report", f"WITH {FLAGGED_SQL} {_REPORT_SQL} ORDER BY prediction")
def sorted_report(spark, sf_dir):
    return cluster_report(flagged(spark, sf_dir)).orderBy("prediction")


@query(
    "a02_report_pages",
    "WITH " + FLAGGED_SQL + """
SELECT prediction, vec_id, round(distance, 6) AS distance, is_outlier FROM f""",
)
def paged_report(spark, sf_dir):
    """The nested report, unpacked again to compare every row."""
    pages = report_pages(flagged(spark, sf_dir), ["vec_id"], "vec_id", page_rows=20)
    points = pages.select("prediction", F.inline("data_points"))
    return points.withColumn("distance", F.round("distance", 6))


@query(
    "a03_boundary_profile",
    "WITH " + FLAGGED_SQL + """
SELECT prediction, round(computed_boundary, 6) AS computed_boundary, round(min(distance), 6) AS min_distance,
       round(max(distance), 6) AS max_distance, CAST(sum(is_outlier) AS BIGINT) AS n_outliers
FROM f GROUP BY prediction, f.computed_boundary""",
)
def profile(spark, sf_dir):
    found = boundary_profile(flagged(spark, sf_dir))
    rounded = ["computed_boundary", "min_distance", "max_distance"]
    return found.select("prediction", *[F.round(c, 6).alias(c) for c in rounded], "n_outliers")


_HISTOGRAM_SQL = """,
w AS (SELECT prediction, max(distance) / 20 AS w FROM f GROUP BY prediction),
h AS (SELECT prediction, CAST(b AS INTEGER) AS bucket, w * b AS low, w * (b + 1) AS high
      FROM w, (SELECT unnest(range(20)) AS b)),
g AS (SELECT h.prediction, bucket, count(distance) AS n,
             CAST(coalesce(sum(is_outlier), 0) AS BIGINT) AS n_outlier
      FROM h LEFT JOIN f ON f.prediction = h.prediction
       AND (distance > low AND (distance <= high OR bucket = 19) OR bucket = 0 AND distance <= high)
      GROUP BY ALL)"""


@query(
    "a04_distance_histogram",
    "WITH " + FLAGGED_SQL + _HISTOGRAM_SQL + " SELECT prediction, bucket, n, n_outlier FROM g",
)
def histogram(spark, sf_dir):
    return distance_histogram(flagged(spark, sf_dir))


@query(
    "a04_distance_histogram_lineitem",
    "WITH " + LINEITEM_FLAGGED_SQL + _HISTOGRAM_SQL + " SELECT prediction, bucket, n, n_outlier FROM g",
)
def lineitem_histogram(spark, sf_dir):
    return measured_lineitem(spark, sf_dir).histogram()


_BOUNDARY_HISTOGRAM_SQL = """,
r AS (SELECT prediction, min(distance) AS lo, max(distance) AS hi, max(computed_boundary) AS bd,
             CAST(ceil(20 * avg(CASE WHEN distance >= computed_boundary THEN 1.0 ELSE 0.0 END)) AS INTEGER) AS o
      FROM f GROUP BY prediction),
q AS (SELECT prediction, CAST(
        CASE WHEN distance < bd THEN CASE WHEN 20 - o > 1 THEN least(18 - o, floor((distance - lo) / ((bd - lo) / (19 - o)))) ELSE 0 END
             ELSE 20 - o + CASE WHEN o > 1 THEN least(o - 2, floor((distance - bd) / ((hi - bd) / (o - 1)))) ELSE 0 END
        END AS INTEGER) AS bucket, 1 AS one FROM f JOIN r USING (prediction)),
numbered AS (SELECT prediction, CAST(b AS INTEGER) AS bucket, o FROM r, (SELECT unnest(range(20)) AS b))
SELECT numbered.prediction, numbered.bucket, CASE WHEN numbered.bucket >= 20 - o THEN 1 ELSE 0 END AS is_outlier_bucket, count(one) AS n
FROM numbered LEFT JOIN q ON numbered.prediction = q.prediction AND numbered.bucket = q.bucket GROUP BY ALL"""


@query("a05_boundary_histogram", "WITH " + FLAGGED_SQL + _BOUNDARY_HISTOGRAM_SQL)
def aligned_histogram(spark, sf_dir):
    return boundary_histogram(flagged(spark, sf_dir))


@query("a05_boundary_histogram_lineitem", "WITH " + LINEITEM_FLAGGED_SQL + _BOUNDARY_HISTOGRAM_SQL)
def lineitem_aligned_histogram(spark, sf_dir):
    return measured_lineitem(spark, sf_dir).boundary_histogram()


@query(
    "a06_outlier_ratio",
    "WITH " + FLAGGED_SQL + """
SELECT prediction, round(avg(CASE WHEN distance >= computed_boundary THEN 1.0 ELSE 0.0 END), 6) AS outlier_ratio
FROM f GROUP BY prediction""",
)
def ratio(spark, sf_dir):
    found = outlier_ratio(flagged(spark, sf_dir))
    return found.select("prediction", F.round("outlier_ratio", 6).alias("outlier_ratio"))


@query(
    "a07_cluster_summary",
    "WITH " + FLAGGED_SQL + """
SELECT prediction, count(*) AS count, CAST(sum(is_outlier) AS BIGINT) AS outlier_count,
       round(sum(is_outlier) / count(*) * 100, 0) AS outlier_percentage FROM f GROUP BY prediction""",
)
def summary(spark, sf_dir):
    return cluster_summary(flagged(spark, sf_dir))


@query(
    "j01_attach_mean_and_variance",
    """WITH s AS (SELECT l_linenumber AS k, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_linenumber AS prediction, round(m, 6) AS mean, round(v, 6) AS variance
       FROM lineitem JOIN s ON l_linenumber = k""",
)
def attach_moments(spark, sf_dir):
    """Component moments joined to their rows."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    items = items.withColumnRenamed("l_linenumber", "prediction")
    moments = items.groupBy("prediction").agg(
        F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("variance")
    )
    return attach_centers(items, moments).select(
        "l_orderkey", "prediction", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance")
    )


@query(
    "j02_attach_center",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, label AS prediction, CAST(generate_subscripts(c, 1) - 1 AS INT) AS position, round(unnest(c), 6) AS center
FROM e JOIN c USING (label)""",
)
def attach_center(spark, sf_dir):
    own = centered(spark, sf_dir).select("vec_id", "prediction", F.posexplode("centers").alias("position", "c"))
    return own.select("vec_id", "prediction", "position", F.round("c", 6).alias("center"))


@query(
    "j03_center_distance",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, label AS prediction, round(list_distance(v, c), 6) AS distance FROM e JOIN c USING (label)""",
)
def center_distance(spark, sf_dir):
    points = vectors(spark, sf_dir)
    centers = cut(group_centers(points, "prediction", "point"))
    measured = own_center_distance(points, centers, centers.count(), WIDTH, "point")
    return measured.select("vec_id", "prediction", F.round("distance", 6).alias("distance"))


@query(
    "j04_report_with_histogram",
    "WITH " + FLAGGED_SQL + _HISTOGRAM_SQL + f""",
r AS ({_REPORT_SQL})
SELECT r.*, bucket, n, n_outlier FROM r JOIN g USING (prediction)""",
)
def joined_report(spark, sf_dir):
    nested = report_with_histogram(flagged(spark, sf_dir))
    return nested.select("*", F.inline("buckets")).drop("buckets")


_NEAREST_SQL = """,
n AS (SELECT vec_id, e.label, c.label AS prediction,
             row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), c.label) AS r
      FROM e, c)"""


def with_nearest(spark, sf_dir):
    """Vectors with the nearest of the label centers as ``nearest``."""
    points = vectors(spark, sf_dir)
    rows = group_centers(points, "prediction", "point").orderBy("prediction").collect()
    return nearest_center(points, [r["centers"] for r in rows], "point", "nearest")


@query(
    "m04b_nearest_center",
    "WITH " + VECTORS_SQL + _NEAREST_SQL + " SELECT vec_id, label, prediction FROM n WHERE r = 1",
)
def nearest(spark, sf_dir):
    return with_nearest(spark, sf_dir).select(
        "vec_id", F.col("prediction").alias("label"), F.col("nearest").alias("prediction")
    )


@query(
    "m04b_nearest_center_lineitem",
    """WITH s AS (SELECT avg(l_quantity) m0, stddev_samp(l_quantity) s0,
             avg(l_extendedprice) m1, stddev_samp(l_extendedprice) s1,
             avg(l_discount) m2, stddev_samp(l_discount) s2,
             avg(l_tax) m3, stddev_samp(l_tax) s3 FROM lineitem),
z AS (SELECT l_returnflag AS k, (l_quantity - m0) / s0 z0, (l_extendedprice - m1) / s1 z1,
             (l_discount - m2) / s2 z2, (l_tax - m3) / s3 z3 FROM lineitem, s),
c AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, avg(z0) c0, avg(z1) c1, avg(z2) c2, avg(z3) c3 FROM z GROUP BY k),
p AS (SELECT k, (SELECT arg_min(i, power(z0 - c0, 2) + power(z1 - c1, 2) + power(z2 - c2, 2) + power(z3 - c3, 2)) FROM c) AS i FROM z)
SELECT k AS l_returnflag, CAST(i AS INTEGER) AS prediction, count(*) AS n FROM p GROUP BY ALL""",
)
def nearest_lineitem(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_returnflag", *LINEITEM_FEATURES)
    scaled = items.select(
        "l_returnflag", fit_scaler(items, LINEITEM_FEATURES).vector().alias("point")
    )
    rows = group_centers(scaled, "l_returnflag", "point").orderBy("l_returnflag").collect()
    found = nearest_center(scaled, [r["centers"] for r in rows], "point")
    return found.groupBy("l_returnflag", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a01_confusion_matrix",
    "WITH " + VECTORS_SQL + _NEAREST_SQL + """
SELECT label, prediction, count(*) AS count FROM n WHERE r = 1 GROUP BY label, prediction""",
)
def confusion(spark, sf_dir):
    found = nearest(spark, sf_dir)
    return confusion_matrix(found, "label", "prediction")


@query(
    "a08_error_rate",
    "WITH " + VECTORS_SQL + _NEAREST_SQL + """
SELECT round(avg(CASE WHEN label = prediction THEN 0.0 ELSE 1.0 END), 6) AS error_rate FROM n WHERE r = 1""",
)
def error(spark, sf_dir):
    return error_rate(nearest(spark, sf_dir), "label", "prediction").select(
        F.round("error_rate", 6).alias("error_rate")
    )


@query(
    "a09_error_counts",
    """WITH j AS (SELECT quality, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS guess
                  FROM documents LEFT JOIN labels USING (doc_id)),
       x AS (SELECT count(*) AS total, count(*) - count(CASE WHEN quality = guess THEN 1 END) AS errors FROM j)
       SELECT total, errors, round(errors / total, 6) AS error_rate FROM x""",
)
def errors(spark, sf_dir):
    """Document length as a guess of its quality; a document without label is an error."""
    documents = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    labelled = documents.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    guessed = labelled.withColumn("guess", F.when(F.col("n_chars") > 2000, 1).otherwise(0))
    found = error_counts(guessed, "quality", "guess")
    return found.withColumn("error_rate", F.round("error_rate", 6))
