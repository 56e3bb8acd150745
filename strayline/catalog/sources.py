"""Reading, writing and generating tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strayline.catalog.common import FLAGGED_SQL, VECTORS_SQL, flagged, query, table, unit_hash_sql, vectors
from strayline.lineage import scratch_path
from strayline.operators.outliers import cluster_report, group_centers
from strayline.roles import Roles
from strayline.sources import readers, synthetic, writers


@query("s01_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "customer")
    writers.write_csv(table(spark, sf_dir, "customer"), path)
    read = readers.read_csv(spark, path)
    return read.select(
        F.col("c_custkey").cast("bigint"),
        "c_name",
        F.col("c_nationkey").cast("bigint"),
        "c_acctbal",
        "c_mktsegment",
    )


@query(
    "s02_csv_missing_values",
    """SELECT vec_id, vec_id % 4 IN (0, 1) AS is_missing, vec_id % 4 = 2 AS is_not_a_number,
              CASE WHEN vec_id % 4 = 3 THEN CAST(label AS DOUBLE) END AS label
       FROM embeddings""",
)
def csv_missing_values(spark, sf_dir):
    path = scratch_path(spark, "missing")
    kind = F.col("vec_id") % 4
    text = (
        F.when(kind == 0, F.lit("nan"))
        .when(kind == 1, F.lit(None))
        .when(kind == 2, F.lit("NaN"))
        .otherwise(F.col("label").cast("double").cast("string"))
    )
    writers.write_csv(table(spark, sf_dir, "embeddings").select("vec_id", text.alias("label")), path)
    read = readers.read_csv_with_missing(spark, path)
    label = F.col("label")
    return read.select(
        F.col("vec_id").cast("bigint"),
        label.isNull().alias("is_missing"),
        F.coalesce(F.isnan(label), F.lit(False)).alias("is_not_a_number"),
        F.when(~F.isnan(label), label).alias("label"),
    )


@query(
    "s03_read_by_extension",
    """SELECT kind, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, round(sum(s_acctbal), 2) AS balance
       FROM supplier, (VALUES ('csv'), ('json'), ('parquet'), ('txt')) AS kinds(kind) GROUP BY kind""",
)
def read_by_extension(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    parts = []
    for kind in ("csv", "json", "parquet"):
        path = f"{scratch_path(spark, 'supplier')}.{kind}"
        writer = supplier.write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(path)
        read = readers.read_any(spark, path)
        parts.append(
            read.select(
                F.lit(kind).alias("kind"),
                F.col("s_suppkey").cast("bigint").alias("k"),
                F.col("s_acctbal").cast("double").alias("b"),
            )
        )
    path = f"{scratch_path(spark, 'supplier')}.txt"
    supplier.select(F.concat_ws("|", "s_suppkey", "s_acctbal").alias("value")).write.text(path)
    fields = F.split("value", r"\|")
    parts.append(
        readers.read_any(spark, path).select(
            F.lit("txt").alias("kind"), F.get(fields, F.lit(0)).cast("bigint").alias("k"), F.get(fields, F.lit(1)).cast("double").alias("b")
        )
    )
    return (
        reduce(lambda a, b: a.unionByName(b), parts)
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("k").alias("keys"),
            F.round(F.sum("b"), 2).alias("balance"),
        )
    )


@query(
    "s04_json_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders",
)
def json_scan(spark, sf_dir):
    """Every column; the date as text, as JSON has it."""
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    orders.write.json(path)
    return readers.read_json(spark, path, orders.schema).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "s05_text_scan",
    "SELECT p_partkey || '|' || p_name || '|' || p_brand AS value FROM part",
)
def text_scan(spark, sf_dir):
    path = scratch_path(spark, "part")
    part = table(spark, sf_dir, "part")
    part.select(F.concat_ws("|", "p_partkey", "p_name", "p_brand").alias("value")).write.text(path)
    return readers.read_text(spark, path)


@query(
    "s06_parquet_scan_repartition",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
       FROM lineitem GROUP BY ALL""",
)
def parquet_scan(spark, sf_dir):
    read = readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet", partitions=16)
    return read.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "s07_wide_pixel_csv",
    """WITH p AS (SELECT CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label,
                list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(128 + 100 * x) AS BIGINT)) AS e FROM embeddings),
       u AS (SELECT label, unnest(e) AS pixel, generate_subscripts(e, 1) - 1 AS i FROM p),
       g AS (SELECT label, i, count(*) AS n, sum(pixel) AS total FROM u GROUP BY label, i)
       SELECT label, CAST(place AS INTEGER) AS place, n, CAST(total AS BIGINT) AS total
       FROM g JOIN (SELECT unnest(range(784)) AS place) ON place % 64 = i""",
)
def wide_pixel_csv(spark, sf_dir):
    """All 784 pixels of both files, summed by label; the test file has none."""
    path = scratch_path(spark, "pixels")
    embeddings = table(spark, sf_dir, "embeddings")
    pixels = [
        f"cast(floor(128 + 100D * embedding[{i % 64}]) AS int) AS pixel{i}" for i in range(784)
    ]
    writers.write_csv(embeddings.filter("vec_id % 5 != 0").selectExpr("label", *pixels), f"{path}/train.csv")
    writers.write_csv(embeddings.filter("vec_id % 5 = 0").selectExpr(*pixels), f"{path}/test.csv")
    train, test = readers.read_pixels(spark, path)
    each = F.array(*[F.col(f"pixel{i}") for i in range(784)])
    return (
        train.select("label", F.posexplode(each).alias("place", "pixel"))
        .unionByName(test.select(F.lit(-1).alias("label"), F.posexplode(each).alias("place", "pixel")))
        .groupBy("label", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pixel").alias("total"))
    )


@query("s09_csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "part")
    kept = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    writers.write_csv(kept, path)
    writers.write_csv(kept, path)
    return readers.read_csv(spark, path, kept.schema)


@query("s10_parquet_sink", "SELECT * REPLACE (epoch_us(ts) AS ts) FROM events")
def parquet_sink(spark, sf_dir):
    """Every column; the time in microseconds since 1970."""
    path = scratch_path(spark, "events")
    writers.write_parquet(table(spark, sf_dir, "events"), path)
    return readers.read_parquet(spark, path).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "s11_json_result",
    "WITH " + FLAGGED_SQL + """
SELECT 'cluster' AS job, prediction, count(*) AS amount, CAST(sum(is_outlier) AS BIGINT) AS amount_outlier,
       round(100 * sum(is_outlier) / count(*), 3) AS percentage_outlier
FROM f GROUP BY prediction""",
)
def json_result(spark, sf_dir):
    path = scratch_path(spark, "result")
    report = cluster_report(flagged(spark, sf_dir))
    writers.write_json_result(report, path, "cleaning")
    schema = "prediction int, amount bigint, amount_outlier bigint, percentage_outlier double, job string"
    return spark.read.schema(schema).json(path)


@query(
    "s12_declared_schema",
    "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_brand, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part",
)
def declared_schema(spark, sf_dir):
    roles = Roles.of("p_partkey", "p_brand", ["p_retailprice", "p_size"])
    path = scratch_path(spark, "roles")
    writers.write_csv(table(spark, sf_dir, "part").select(*roles.columns), path)
    return readers.read_roles(spark, path, roles)


def _normals_sql() -> str:
    """Box-Muller on hashed uniforms around the label's mean, a column per feature."""
    normal = lambda j: f"sqrt(-2 * ln(1 - {unit_hash_sql('id', 2 * j)})) * cos(2 * pi() * {unit_hash_sql('id', 2 * j + 1)})"
    columns = ", ".join(f"round(c[{j + 1}] + 0.1 * {normal(j)}, 6) AS f{j}" for j in range(64))
    return "WITH " + VECTORS_SQL + f""",
o AS (SELECT label, count(*) AS n FROM e GROUP BY label),
s AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k, n, sum(n) OVER (ORDER BY label) - n AS start FROM o),
p AS (SELECT CAST(start + i AS BIGINT) AS id, k, c FROM s JOIN c USING (label), LATERAL (SELECT unnest(range(n)) AS i))
SELECT {columns}, id, k FROM p"""


@query("g01_gaussian_clusters", _normals_sql())
def gaussian_clusters(spark, sf_dir):
    """As many rows per cluster as the table has per label, around its mean vector."""
    points = vectors(spark, sf_dir)
    centers = group_centers(points, "prediction", "point").join(
        points.groupBy("prediction").count(), "prediction"
    )
    rows = centers.orderBy("prediction").collect()
    names = [f"f{i}" for i in range(64)]
    made = synthetic.gaussian_clusters(
        spark, [r["count"] for r in rows], [r["centers"] for r in rows], [[0.1] * 64 for _ in rows], features=names
    )
    return made.select(*[F.round(c, 6).alias(c) for c in names], "id", "k")


_HELIX_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM customer),
p AS (SELECT i AS id, CASE WHEN i < n THEN 0.0 ELSE 1.0 END AS label,
             {unit_hash_sql('(i % n)', 3)} * 2 * 3.1415 AS angle, {unit_hash_sql('i', 4)} AS h, n
      FROM n, LATERAL (SELECT unnest(range(2 * n)) AS i)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) <= ceil(n * 0.05) AS drawn FROM p)
SELECT id, CAST(label AS DOUBLE) AS label,
       round(CASE WHEN label = 0 THEN 1.5 ELSE -1.5 END * sin(angle), 6) AS x,
       round(CASE WHEN label = 0 THEN 1.5 ELSE -1.5 END * cos(angle), 6) AS y,
       round(0.5 * angle, 6) AS z,
       CASE WHEN drawn THEN CAST(label AS DOUBLE) END AS unknown_label
FROM r"""


@query("g02_double_helix", _HELIX_SQL)
def double_helix(spark, sf_dir):
    """One point per customer and helix."""
    n = table(spark, sf_dir, "customer").count()
    helix = synthetic.double_helix(spark, n, alpha=1.5, beta=0.5, missing=0.05, seed=3)
    return helix.select(
        "id",
        "label",
        *[F.round(c, 6).alias(c) for c in "xyz"],
        F.when(~F.isnan("unknown_label"), F.col("unknown_label")).alias("unknown_label"),
    )


_SPRINGS_SQL = f"""
WITH g AS (SELECT n_regionkey AS k, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
o AS (SELECT k, n, row_number() OVER (ORDER BY k) - 1 AS s, sum(n) OVER (ORDER BY k) - n AS start FROM g),
p AS (SELECT CAST(start + i AS BIGINT) AS id, s, k + CASE WHEN n > 1 THEN i * 3.0 / (n - 1) ELSE 0 END AS z
      FROM o, LATERAL (SELECT unnest(range(n)) AS i)),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {unit_hash_sql('id', 5)}) <= 2 AS drawn FROM p)
SELECT id, CASE WHEN drawn THEN CAST(s AS DOUBLE) END AS label,
       round(2.5 * sin(z), 6) AS x, round(2.5 * cos(z), 6) AS y, round(z, 6) AS z
FROM r"""


@query("g03_springs", _SPRINGS_SQL)
def springs(spark, sf_dir):
    """One spring per region with as many points as it has suppliers."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    rows = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey")
        .count()
        .orderBy("n_regionkey")
        .collect()
    )
    ranges = [(float(r["n_regionkey"]), r["n_regionkey"] + 3.0, r["count"]) for r in rows]
    made = synthetic.springs(spark, 2.5, ranges, draws=2, seed=5)
    return made.select(
        "id",
        F.when(~F.isnan("label"), F.col("label")).alias("label"),
        *[F.round(F.get("vector", F.lit(i)), 6).alias(c) for i, c in enumerate("xyz")],
    )
