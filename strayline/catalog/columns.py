"""Projections, predicates, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strayline.catalog.common import (
    unit_hash_sql,
    FLAGGED_SQL,
    LINEITEM_FEATURES,
    VECTORS_SQL,
    flagged,
    query,
    table,
    vectors,
)
from strayline.functions import durations
from strayline.functions.text import file_extension
from strayline.functions.vectors import argmax, one_hot, scale_by
from strayline.operators.features import (
    CastColumn,
    DenseVector,
    assemble,
    cast_column,
    fit_scaler,
    nonzero_entries,
    select_labels,
    shift_clusters,
    split_known,
)
from strayline.operators.outliers import data_point, drill_down
from strayline.operators.sampling import jittered
from strayline.roles import Roles
from strayline.sources.writers import as_json_rows


@query(
    "p01_role_projection",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(NULL AS DOUBLE) AS c_mktsegment,
              CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
              round(CAST(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_acctbal AS FLOAT) END AS DOUBLE), 4) AS balance_text
       FROM customer""",
)
def role_projection(spark, sf_dir):
    """Text labels that are no numbers, and text features with bad entries, become NULL."""
    text = F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    customer = table(spark, sf_dir, "customer").withColumn("balance_text", text)
    roles = Roles.of("c_custkey", ["c_mktsegment", "c_nationkey"], ["c_acctbal", "balance_text"])
    return roles.project(customer).withColumn(
        "balance_text", F.round(F.col("balance_text").cast("double"), 4)
    )


@query(
    "p02_checked_cast",
    """SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
              round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 4) AS l_extendedprice FROM lineitem""",
)
def checked_cast(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    step = CastColumn(inputCol="l_linenumber", castTo="double")
    single = cast_column(step.transform(items), "l_extendedprice", "float")
    return cast_column(single, "l_extendedprice", "double").withColumn(
        "l_extendedprice", F.round("l_extendedprice", 4)
    )


@query(
    "p03_assemble",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS first, p_retailprice AS second, CAST(2 AS INTEGER) AS width FROM part""",
)
def assemble_features(spark, sf_dir):
    part = assemble(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return part.select(
        "p_partkey",
        F.get("features", F.lit(0)).alias("first"),
        F.get("features", F.lit(1)).alias("second"),
        F.size("features").alias("width"),
    )


@query(
    "p04_dense_vector",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, len(v) AS width, round(list_sum(v), 6) AS total FROM e""",
)
def dense_vector(spark, sf_dir):
    points = vectors(spark, sf_dir).withColumn("vector", array_to_vector("point"))
    dense = DenseVector(inputCol="vector", outputCol="dense").transform(points)
    values = dense.withColumn("values", vector_to_array("dense"))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return values.select(
        "vec_id", F.size("values").cast("bigint").alias("width"), F.round(total, 6).alias("total")
    )


@query(
    "p05_nonzero_entries",
    """SELECT l_orderkey, position, value
       FROM (SELECT l_orderkey, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS position,
                    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)
       WHERE value <> 0""",
)
def nonzero(spark, sf_dir):
    items = assemble(table(spark, sf_dir, "lineitem", "l_orderkey", *LINEITEM_FEATURES), LINEITEM_FEATURES)
    return nonzero_entries(items, "l_orderkey", "features")


@query(
    "p06_standardize",
    """WITH s AS (SELECT avg(l_quantity) m0, stddev_samp(l_quantity) s0, avg(l_extendedprice) m1,
              stddev_samp(l_extendedprice) s1, avg(l_discount) m2, stddev_samp(l_discount) s2,
              avg(l_tax) m3, stddev_samp(l_tax) s3 FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_quantity - m0) / s0, 6) AS z0,
              round((l_extendedprice - m1) / s1, 6) AS z1, round((l_discount - m2) / s2, 6) AS z2,
              round((l_tax - m3) / s3, 6) AS z3, 0.0::DOUBLE AS z4
       FROM lineitem, s""",
)
def standardized(spark, sf_dir):
    """The fifth feature is constant, and so becomes 0."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *LINEITEM_FEATURES)
    items = items.withColumn("constant", F.lit(7.0))
    scaled = fit_scaler(items, [*LINEITEM_FEATURES, "constant"]).columns()
    return items.select(
        "l_orderkey", "l_linenumber", *[F.round(c, 6).alias(f"z{i}") for i, c in enumerate(scaled)]
    )


@query("p07_select_labels", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)")
def labels_selected(spark, sf_dir):
    return select_labels(table(spark, sf_dir, "embeddings", "vec_id", "label"), "label", [1, 3, 5])


@query(
    "p08_split_known",
    """SELECT CASE WHEN quality = 1 THEN 'known' ELSE 'unknown' END AS part, count(*) AS n
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def known_split(spark, sf_dir):
    """Documents without label are NULL, those of quality 0 are made NaN: both are unknown."""
    documents = table(spark, sf_dir, "documents", "doc_id")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    value = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, F.lit(float("nan")))
    labelled = documents.join(labels, "doc_id", "left").withColumn("label", value)
    known, unknown = split_known(labelled, "label")
    return (
        known.select(F.lit("known").alias("part"))
        .unionByName(unknown.select(F.lit("unknown").alias("part")))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("p09_range_predicate", "SELECT vec_id, label FROM embeddings WHERE label < 2.0")
def range_predicate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "label").filter(F.col("label") < 2.0)


@query("p10_shift_clusters", "SELECT vec_id, label + 1 AS prediction FROM embeddings")
def shifted(spark, sf_dir):
    return shift_clusters(vectors(spark, sf_dir).drop("point"))


@query("p11_rename_drop", "SELECT vec_id, label AS original_label FROM embeddings")
def rename_drop(spark, sf_dir):
    return (
        table(spark, sf_dir, "embeddings")
        .withColumnRenamed("label", "original_label")
        .drop("embedding")
    )


@query("p12_feature_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def feature_columns(spark, sf_dir):
    """Whatever is neither id nor label is a feature."""
    customer = table(spark, sf_dir, "customer")
    roles = Roles.from_columns(customer, "c_custkey", ["c_name", "c_mktsegment"])
    return customer.select(*roles.id, *roles.features)


@query(
    "p13_data_point_struct",
    "WITH " + FLAGGED_SQL + " SELECT prediction, vec_id, round(distance, 6) AS distance, is_outlier FROM f",
)
def struct_points(spark, sf_dir):
    packed = flagged(spark, sf_dir).select("prediction", data_point(["vec_id"]))
    return packed.select(
        "prediction",
        "data_point.vec_id",
        F.round("data_point.distance", 6).alias("distance"),
        "data_point.is_outlier",
    )


@query(
    "p14_conditional",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS is_large FROM orders""",
)
def conditional(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("is_large")
    )


@query(
    "p15_drill_down",
    "WITH " + FLAGGED_SQL + """
SELECT vec_id, prediction, round(distance, 6) AS distance FROM f
WHERE prediction = 3 AND is_outlier = 1 ORDER BY f.distance DESC, vec_id""",
)
def outlier_drill_down(spark, sf_dir):
    return drill_down(flagged(spark, sf_dir), 3, "vec_id").select(
        "vec_id", "prediction", F.round("distance", 6).alias("distance")
    )


@query("o03_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(25)
    )


@query(
    "o04_argmax",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS DOUBLE) AS best FROM e""",
)
def argmax_class(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", argmax("point").alias("best"))


@query(
    "u01_bag_union",
    """SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer
       UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation""",
)
def bag_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return customers.unionByName(suppliers).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("u02_id_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").subtract(table(spark, sf_dir, "labels", "doc_id"))


@query("u03_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "f05_prior_product",
    "WITH " + VECTORS_SQL + """
SELECT vec_id, p - 1 AS class, round(x * (p / 2080.0::DOUBLE), 6) AS score
FROM (SELECT vec_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) AS INT) AS p FROM e)""",
)
def prior_product(spark, sf_dir):
    """All 64 values of a vector as scores, class i with a prior of (i + 1) / 2080."""
    priors = [(i + 1) / 2080.0 for i in range(64)]
    weighed = vectors(spark, sf_dir).withColumn("w", scale_by("point", priors))
    return weighed.select("vec_id", F.posexplode("w").alias("class", "x")).select(
        "vec_id", "class", F.round("x", 6).alias("score")
    )


@query(
    "f06_one_hot",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN 0.5 WHEN quality = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS s0,
              CASE WHEN quality IS NULL THEN 0.5 WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS s1
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def one_hot_rows(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id")
    labelled = documents.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    rows = labelled.withColumn("scores", one_hot(F.col("quality"), 2))
    return rows.select("doc_id", F.get("scores", F.lit(0)).alias("s0"), F.get("scores", F.lit(1)).alias("s1"))


@query(
    "f09_jitter",
    f"""SELECT p_partkey, p_size + {unit_hash_sql('p_partkey', 8)} AS p_size, p_retailprice + {unit_hash_sql('p_partkey', 9)} AS p_retailprice
        FROM part""",
)
def jitter(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    return jittered(part, ["p_size", "p_retailprice"], 7, ["p_partkey"])


@query(
    "f10_duration_to_seconds",
    """SELECT event_id, round(CASE event_id % 4
         WHEN 0 THEN user_id * 3600.0 + (event_id % 60) * 60
         WHEN 1 THEN (event_id % 60) * 60 + user_id + 0.321
         WHEN 2 THEN value / 1000
         ELSE NULL END, 6)::DOUBLE AS seconds FROM events""",
)
def duration_to_seconds(spark, sf_dir):
    """Durations written in four ways, the last in a unit nobody knows."""
    minutes = F.col("event_id") % 60
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat("user_id", F.lit("h "), minutes, F.lit("min")))
        .when(kind == 1, F.concat(minutes, F.lit(" min "), "user_id", F.lit(" s 321 ms")))
        .when(kind == 2, F.concat(F.format_string("%.2f", "value"), F.lit(" ms")))
        .otherwise(F.concat("user_id", F.lit(" weeks")))
    )
    events = table(spark, sf_dir, "events").withColumn("duration", text)
    return events.select("event_id", F.round(durations.to_seconds("duration"), 6).alias("seconds"))


_SHORT = """CASE WHEN x >= 100 THEN format('{:.0f}', x) WHEN x >= 10 THEN regexp_replace(regexp_replace(format('{:.1f}', x), '0+$', ''), '\\.$', '')
 ELSE regexp_replace(regexp_replace(format('{:.2f}', x), '0+$', ''), '\\.$', '') END"""


@query(
    "f11_seconds_to_text",
    f"""WITH t AS (SELECT event_id, (event_id % 7) * 1000 + event_id % 50 AS long, user_id + 1 AS whole FROM events),
        u AS (SELECT event_id, long, whole, whole / 1000.0 AS short FROM t)
        SELECT event_id,
          CASE WHEN long >= 60 THEN concat_ws(' ',
                 CASE WHEN long // 3600 > 0 THEN CAST(CAST(long // 3600 AS BIGINT) AS VARCHAR) || 'h' END,
                 CASE WHEN (long % 3600) // 60 > 0 THEN CAST(CAST((long % 3600) // 60 AS BIGINT) AS VARCHAR) || 'min' END,
                 CASE WHEN long % 60 > 0 THEN CAST(CAST(long % 60 AS BIGINT) AS VARCHAR) || 's' END)
               WHEN long = 0 THEN '0 ns' ELSE CAST(CAST(long AS BIGINT) AS VARCHAR) || ' s' END AS long_text,
          CASE WHEN whole >= 1000 THEN (SELECT {_SHORT} FROM (SELECT short AS x)) || ' s'
               ELSE CAST(whole AS VARCHAR) || ' ms' END AS short_text
        FROM u""",
)
def seconds_to_text(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    long = (F.col("event_id") % 7) * 1000.0 + F.col("event_id") % 50
    return events.select(
        "event_id",
        durations.to_text(long).alias("long_text"),
        durations.to_text((F.col("user_id") + 1) / 1000).alias("short_text"),
    )


@query(
    "f14_file_extension",
    r"""SELECT page_id, regexp_extract(url, '\.\w+$') AS extension,
               regexp_extract(regexp_replace(url, '[/?].*$', ''), '\.\w+$') AS scheme_extension,
               regexp_extract(regexp_extract(url, '^\w+://([^/]+)', 1), '\.\w+$') AS host_extension
        FROM pages""",
)
def extensions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select(
        "page_id",
        file_extension("url").alias("extension"),
        file_extension(F.regexp_replace("url", "[/?].*$", "")).alias("scheme_extension"),
        file_extension(F.regexp_extract("url", r"^\w+://([^/]+)", 1)).alias("host_extension"),
    )


@query("f15_trigonometry", "SELECT event_id, round(2.5 * sin(value), 6) AS x, round(2.5 * cos(value), 6) AS y FROM events")
def trigonometry(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(2.5 * F.sin("value"), 6).alias("x"),
        F.round(2.5 * F.cos("value"), 6).alias("y"),
    )


@query(
    "f16_row_as_json",
    """SELECT 'cluster' AS job, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'customers': customers}) AS VARCHAR) AS row
       FROM (SELECT n_nationkey, n_name, count(*) AS customers FROM customer
             JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
)
def row_as_json(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer", "c_nationkey")
    counted = (
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return as_json_rows(counted, "cleaning")
