"""The query registry and the inputs several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayline.operators.outliers import Distances, attach_centers, detect_outliers, group_centers, measure
from strayline.operators.features import fit_scaler

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL that gives the same rows."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt out to all; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, point, prediction``: each vector with its label as cluster."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("point"),
        F.col("label").alias("prediction"),
    )


WIDTH = 64


def centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vectors(spark, sf_dir)
    return attach_centers(points, group_centers(points, "prediction", "point", width=WIDTH))


def flagged(spark: SparkSession, sf_dir: str, row_id: str | None = None) -> DataFrame:
    return detect_outliers(
        centered(spark, sf_dir), point="point", row_id=row_id, width=WIDTH
    )


def measured_lineitem(spark: SparkSession, sf_dir: str) -> Distances:
    """Distances of line items in standardised feature space, clustered by line number."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *LINEITEM_FEATURES)
    scaled = items.select(
        "l_orderkey",
        F.col("l_linenumber").alias("prediction"),
        fit_scaler(items, LINEITEM_FEATURES).vector().alias("point"),
    )
    width = len(LINEITEM_FEATURES)
    joined = attach_centers(scaled, group_centers(scaled, "prediction", "point", width=width))
    return measure(joined, ["l_orderkey"], point="point", width=width)


def flagged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_lineitem(spark, sf_dir).flagged()


VECTORS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (
  SELECT label, list(m ORDER BY p) AS c
  FROM (SELECT label, p, avg(x) AS m
        FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e)
        GROUP BY label, p)
  GROUP BY label)"""

FLAGGED_SQL = (
    VECTORS_SQL
    + """,
d AS (SELECT vec_id, label + 1 AS prediction, list_distance(v, c) AS distance
      FROM e JOIN c USING (label)),
b AS (SELECT prediction, avg(distance) + 2 * stddev_pop(distance) AS computed_boundary
      FROM d GROUP BY prediction),
f AS (SELECT d.*, computed_boundary,
             CASE WHEN distance > computed_boundary THEN 1 ELSE 0 END AS is_outlier
      FROM d JOIN b USING (prediction))"""
)

LINEITEM_FLAGGED_SQL = """
s AS (SELECT avg(l_quantity) m0, stddev_samp(l_quantity) s0,
             avg(l_extendedprice) m1, stddev_samp(l_extendedprice) s1,
             avg(l_discount) m2, stddev_samp(l_discount) s2,
             avg(l_tax) m3, stddev_samp(l_tax) s3 FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber AS k, (l_quantity - m0) / s0 z0, (l_extendedprice - m1) / s1 z1,
             (l_discount - m2) / s2 z2, (l_tax - m3) / s3 z3 FROM lineitem, s),
c AS (SELECT k, avg(z0) c0, avg(z1) c1, avg(z2) c2, avg(z3) c3 FROM z GROUP BY k),
d AS (SELECT l_orderkey, k + 1 AS prediction,
             sqrt(power(z0 - c0, 2) + power(z1 - c1, 2) + power(z2 - c2, 2) + power(z3 - c3, 2)) AS distance
      FROM z JOIN c USING (k)),
b AS (SELECT prediction, avg(distance) + 2 * stddev_pop(distance) AS computed_boundary
      FROM d GROUP BY prediction),
f AS (SELECT d.*, computed_boundary,
             CASE WHEN distance > computed_boundary THEN 1 ELSE 0 END AS is_outlier
      FROM d JOIN b USING (prediction))"""


def unit_hash_sql(key: str, seed: int = 0) -> str:
    """SQL twin of ``hash_unit`` for one key."""
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0"
