"""Distance outliers per cluster: boundaries, flags, reports and histograms.

Everything that depends on a whole cluster comes from one small aggregate,
joined back by cluster. Partial aggregation makes a huge cluster harmless.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.functions.vectors import euclidean_distance, percentage_distance
from strayline.lineage import cut
from strayline.operators.features import WIDE_MEANS_LIMIT, shift_clusters
from strayline.operators.moments import first_width, vector_moments
from strayline.operators.row_ids import add_row_id


def group_centers(
    df: DataFrame, cluster: str, point: str, output: str = "centers", width: int | None = None
) -> DataFrame:
    """Mean vector of each cluster, in one pass.

    Up to ``WIDE_MEANS_LIMIT`` dimensions a row adds to one buffer per cluster;
    beyond, tasks add up their clusters in Arrow batches. The vectors of a table have one
    length, anything else is an error.
    """
    width = width or first_width(df, point)
    if width is not None and width <= WIDE_MEANS_LIMIT:
        size = F.when(F.col(point).isNotNull(), F.size(point))
        uneven = F.concat(F.lit("vectors of "), F.min(size), F.lit(" to "), F.max(size), F.lit(" dimensions"))
        each = F.array(*[F.avg(F.get(point, F.lit(i))) for i in range(width)])
        checked = F.when(F.min(size) != F.max(size), F.raise_error(uneven)).otherwise(each)
        return df.groupBy(cluster).agg(checked.alias(output))
    means = vector_moments(df, point, cluster, width)
    ordered = F.array_sort(F.collect_list(F.struct("position", "mean")))
    return means.groupBy(cluster).agg(F.transform(ordered, lambda e: e["mean"]).alias(output))


def attach_centers(df: DataFrame, centers: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Add each row's own center, that of a NULL cluster included.

    The centers are worked out and written first: Spark then knows their size
    when it plans, and broadcasts them, if small, without shuffling the rows.
    """
    return with_bounds(df, centers, cluster, *[c for c in centers.columns if c != cluster])


def add_distance(
    df: DataFrame,
    point: str = "scaled_features",
    center: str = "centers",
    output: str = "distance",
    width: int | None = None,
) -> DataFrame:
    return df.withColumn(output, euclidean_distance(point, center, width))


def cluster_bounds(
    df: DataFrame, cluster: str = "prediction", distance: str = "distance", no_stddev: float = 2.0
) -> DataFrame:
    """One row per cluster: size, smallest and largest distance, outlier boundary."""
    boundary = F.avg(distance) + F.lit(float(no_stddev)) * F.stddev_pop(distance)
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("amount"),
        F.min(distance).alias("min_distance"),
        F.max(distance).alias("max_distance"),
        boundary.alias("computed_boundary"),
    )


def with_bounds(df: DataFrame, bounds: DataFrame, cluster: str, *columns: str) -> DataFrame:
    """Join columns of a per-cluster table to the rows, a NULL cluster included.

    As with centers, the table is written first and joined by its known size.
    """
    renamed = cut(bounds.select(F.col(cluster).alias("_cluster"), *columns))
    return df.join(renamed, F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")


def flag_outliers(
    df: DataFrame, cluster: str = "prediction", distance: str = "distance", no_stddev: float = 2.0
) -> DataFrame:
    """Add ``computed_boundary`` and ``is_outlier`` (1 beyond the boundary)."""
    bounds = cluster_bounds(df, cluster, distance, no_stddev)
    beyond = F.when(F.col(distance) > F.col("computed_boundary"), 1).otherwise(0)
    return with_bounds(df, bounds, cluster, "computed_boundary").withColumn("is_outlier", beyond)


def detect_outliers(
    df: DataFrame,
    cluster: str = "prediction",
    point: str = "scaled_features",
    center: str = "centers",
    no_stddev: float = 2.0,
    row_id: str | None = "rowId",
    width: int | None = None,
) -> DataFrame:
    """Number clusters from 1, number rows, add distances and outlier flags."""
    shifted = shift_clusters(df, cluster)
    if row_id is not None:
        shifted = add_row_id(shifted, row_id)
    return flag_outliers(add_distance(shifted, point, center, width=width), cluster, "distance", no_stddev)


@dataclass(frozen=True)
class Distances:
    """The narrow table all reports share: ``cluster, keys.., distance``, and the clusters' bounds.

    Both are written, so the rows behind them are read once, however many reports follow,
    and the bounds are joined by their known size.
    """

    rows: DataFrame
    bounds: DataFrame
    cluster: str = "prediction"
    distance: str = "distance"

    def with_bounds(self, *columns: str) -> DataFrame:
        renamed = self.bounds.select(F.col(self.cluster).alias("_cluster"), *columns)
        return self.rows.join(renamed, F.col(self.cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")

    def flagged(self) -> DataFrame:
        beyond = F.when(F.col(self.distance) > F.col("computed_boundary"), 1).otherwise(0)
        return self.with_bounds("computed_boundary").withColumn("is_outlier", beyond)

    def report(self) -> DataFrame:
        return cluster_report(self.flagged(), self.cluster)

    def summary(self) -> DataFrame:
        return cluster_summary(self.flagged(), self.cluster)

    def histogram(self, n_buckets: int = 20) -> DataFrame:
        tops = self.bounds.withColumnRenamed("max_distance", "_top")
        joined = self.with_bounds("computed_boundary", F.col("max_distance").alias("_top"))
        return _equal_width(joined, tops, n_buckets, self.cluster, self.distance, "computed_boundary")

    def boundary_histogram(self, n_buckets: int = 20) -> DataFrame:
        named = self.with_bounds("computed_boundary")
        return _aligned(named, n_buckets, self.cluster, self.distance, "computed_boundary")


def measure(
    df: DataFrame,
    keys: Sequence[str],
    cluster: str = "prediction",
    point: str = "scaled_features",
    center: str = "centers",
    no_stddev: float = 2.0,
    width: int | None = None,
) -> Distances:
    """Distances of rows from their centers, clusters numbered from 1, for any number of reports."""
    measured = add_distance(shift_clusters(df, cluster), point, center, width=width)
    rows = cut(measured.select(cluster, *keys, "distance"))
    return Distances(rows, cut(cluster_bounds(rows, cluster, "distance", no_stddev)), cluster)


def add_percentage_distance(
    df: DataFrame, cluster: str = "prediction", distance: str = "distance"
) -> DataFrame:
    """Add ``(largest distance of the cluster - distance) / 100``."""
    bounds = cluster_bounds(df, cluster, distance)
    share = percentage_distance(distance, F.col("max_distance"))
    return (
        with_bounds(df, bounds, cluster, "max_distance")
        .withColumn("percentage_distance", share)
        .drop("max_distance")
    )


def outlier_ratio(df: DataFrame, cluster: str = "prediction", distance: str = "distance",
                  boundary: str = "computed_boundary") -> DataFrame:
    """Share of each cluster at or beyond its boundary."""
    at_or_beyond = F.when(F.col(distance) >= F.col(boundary), 1.0).otherwise(0.0)
    return df.groupBy(cluster, boundary).agg(F.avg(at_or_beyond).alias("outlier_ratio"))


def boundary_profile(df: DataFrame, cluster: str = "prediction", distance: str = "distance") -> DataFrame:
    """Smallest and largest distance and number of outliers per cluster and boundary."""
    return df.groupBy(cluster, "computed_boundary").agg(
        F.min(distance).alias("min_distance"),
        F.max(distance).alias("max_distance"),
        F.sum("is_outlier").alias("n_outliers"),
    )


def cluster_report(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Rows, outliers and outlier percentage (three decimals) per cluster."""
    return (
        df.groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("amount"), F.sum("is_outlier").alias("amount_outlier"))
        .withColumn(
            "percentage_outlier", F.round(100 * F.col("amount_outlier") / F.col("amount"), 3)
        )
    )


def cluster_summary(df: DataFrame, cluster: str = "prediction", outlier: str = "is_outlier") -> DataFrame:
    """Rows, outliers and outlier percentage in whole numbers per cluster."""
    return (
        df.groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("count"), F.sum(outlier).alias("outlier_count"))
        .withColumn(
            "outlier_percentage", F.round(F.col("outlier_count") / F.col("count") * 100, 0)
        )
    )


def data_point(headers: Sequence[str], name: str = "data_point") -> Column:
    """A row's own columns, its distance and its flag as one struct."""
    return F.struct(*headers, "distance", "is_outlier").alias(name)


def report_pages(
    df: DataFrame,
    headers: Sequence[str],
    key: str,
    cluster: str = "prediction",
    name: str = "data_points",
    page_rows: int = 1000,
) -> DataFrame:
    """Nested report: all rows of a cluster as lists of about ``page_rows`` structs.

    A list of a whole cluster would have to fit into one row; pages keep every
    row while no list grows with the cluster.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_amount"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_amount") / page_rows))
    return (
        with_bounds(df, sizes, cluster, "_amount")
        .select(cluster, F.pmod(F.xxhash64(key), pages).alias("page"), data_point(headers, "_point"))
        .groupBy(cluster, "page")
        .agg(F.collect_list("_point").alias(name))
    )


def _bucket(distance: Column, width: Column, n_buckets: int) -> Column:
    """Bucket i holds ``width * i < d <= width * (i + 1)``; 0 in the first.

    The divided candidate can miss an edge by one in floating point, so it is
    checked against both edges.
    """
    guess = F.ceil(distance / width) - 1
    exact = (
        F.when(distance <= width * guess, guess - 1)
        .when(distance > width * (guess + 1), guess + 1)
        .otherwise(guess)
    )
    kept = F.greatest(F.lit(0), F.least(F.lit(n_buckets - 1), exact))
    return F.when(width > 0, kept).otherwise(0).cast("int")


def distance_histogram(
    df: DataFrame,
    n_buckets: int = 20,
    cluster: str = "prediction",
    distance: str = "distance",
    boundary: str = "computed_boundary",
) -> DataFrame:
    """Equal-width histogram per cluster: ``bucket, n, n_outlier``, empty ones too.

    The rows are read once, for cluster, distance and boundary; all else comes from
    that narrow table.
    """
    df = cut(df.select(cluster, distance, boundary))
    tops = cut(df.groupBy(cluster, boundary).agg(F.max(distance).alias("_top")))
    return _equal_width(with_bounds(df, tops, cluster, "_top"), tops, n_buckets, cluster, distance, boundary)


def _equal_width(joined: DataFrame, tops: DataFrame, n_buckets: int, cluster: str, distance: str, boundary: str) -> DataFrame:
    """Counts per cluster and bucket of rows that carry their cluster's largest distance ``_top``."""
    width = F.col("_top") / F.lit(n_buckets)
    filled = joined.select(
        cluster,
        _bucket(F.col(distance), width, n_buckets).alias("bucket"),
        F.lit(1).cast("bigint").alias("n"),
        F.when(F.col(distance) > F.col(boundary), 1).otherwise(0).cast("bigint").alias("n_outlier"),
    )
    empty = tops.select(
        cluster,
        F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("n_outlier"),
    )
    return (
        filled.unionByName(empty)
        .groupBy(cluster, "bucket")
        .agg(F.sum("n").alias("n"), F.sum("n_outlier").alias("n_outlier"))
    )


def boundary_histogram(
    df: DataFrame,
    n_buckets: int = 20,
    cluster: str = "prediction",
    distance: str = "distance",
    boundary: str = "computed_boundary",
) -> DataFrame:
    """Histogram whose edges meet the outlier boundary.

    ``ceil(n_buckets * share of outliers)`` edges lie evenly between boundary and
    largest distance, the others between smallest distance and boundary. Bucket i
    holds ``edge i <= d < edge i + 1``; the last one is closed, or open-ended when
    the boundary is the only outlier edge.
    """
    return _aligned(cut(df.select(cluster, distance, boundary)), n_buckets, cluster, distance, boundary)


def _aligned(df: DataFrame, n_buckets: int, cluster: str, distance: str, boundary: str) -> DataFrame:
    d, b = F.col(distance), F.col(boundary)
    at_or_beyond = F.when(d >= b, 1.0).otherwise(0.0)
    edges = cut(
        df.groupBy(cluster, boundary).agg(
            F.min(distance).alias("_low"),
            F.max(distance).alias("_high"),
            F.ceil(F.lit(n_buckets) * F.avg(at_or_beyond)).cast("int").alias("_outer"),
        )
    )
    inner = F.lit(n_buckets) - F.col("_outer")
    inner_step = (b - F.col("_low")) / (inner - 1)
    outer_step = (F.col("_high") - b) / (F.col("_outer") - 1)
    inner_bucket = F.when(
        inner > 1, F.least(inner - 2, F.floor((d - F.col("_low")) / inner_step))
    ).otherwise(0)
    outer_bucket = F.when(
        (F.col("_outer") > 1) & (F.col("_high") > b),
        F.least(F.col("_outer") - 2, F.floor((d - b) / outer_step)),
    ).otherwise(0)
    bucket = F.when(d < b, inner_bucket).otherwise(inner + outer_bucket).cast("int")
    filled = with_bounds(df, edges, cluster, "_low", "_high", "_outer").select(
        cluster,
        bucket.alias("bucket"),
        F.when(bucket >= inner, 1).otherwise(0).alias("is_outlier_bucket"),
        F.lit(1).cast("bigint").alias("n"),
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket")
    empty = edges.select(cluster, "_outer", numbers).select(
        cluster,
        "bucket",
        F.when(F.col("bucket") >= inner, 1).otherwise(0).alias("is_outlier_bucket"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        filled.unionByName(empty)
        .groupBy(cluster, "bucket", "is_outlier_bucket")
        .agg(F.sum("n").alias("n"))
    )


def report_with_histogram(
    df: DataFrame, n_buckets: int = 20, cluster: str = "prediction"
) -> DataFrame:
    """Report joined with each cluster's histogram as an array of ``n_buckets`` structs."""
    bars = F.array_sort(F.collect_list(F.struct("bucket", "n", "n_outlier")))
    histogram = (
        distance_histogram(df, n_buckets, cluster).groupBy(cluster).agg(bars.alias("buckets"))
    )
    return cluster_report(df, cluster).join(histogram, cluster)


def drill_down(df: DataFrame, cluster_id, key: str, cluster: str = "prediction") -> DataFrame:
    """Outliers of one cluster, farthest first."""
    return df.filter((F.col(cluster) == F.lit(cluster_id)) & (F.col("is_outlier") == 1)).orderBy(
        F.desc("distance"), key
    )
