"""Similarity graphs, matrix products and label propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayline.catalog.common import VECTORS_SQL, query, table, vectors
from strayline.operators.graph import (
    matrix_product,
    mean_symmetric,
    similarity_edges,
    symmetric_graph,
)
from strayline.operators.propagation import (
    class_mass_normalization,
    class_priors,
    known_labels,
    label_matrix,
    label_propagation,
    propagate,
    propagation_step,
)
from strayline.operators.generative import class_counts
from strayline.operators.metrics import label_counts
from strayline.operators.tiles import similarity as similarity_tiles
from strayline.operators.tiles import transition as transition_of

SIGMA, TOL, CLASSES = 0.6, 0.01, 10


def edges_of(spark, sf_dir):
    """Triangle of the graph over the embeddings, not standardised."""
    return similarity_edges(
        vectors(spark, sf_dir), "vec_id", "point", SIGMA, TOL, standardize=False
    )


def graph_of(spark, sf_dir):
    """The same graph as a matrix of tiles."""
    return similarity_tiles(vectors(spark, sf_dir), "vec_id", "point", SIGMA, TOL, standardize=False)


def hidden(spark, sf_dir):
    """Embeddings with the labels of two thirds of them hidden."""
    label = F.when(F.col("vec_id") % 3 == 0, F.col("prediction").cast("double"))
    return vectors(spark, sf_dir).select("vec_id", "point", label.alias("label"))


EDGES_SQL = VECTORS_SQL + f""",
edges AS MATERIALIZED (
  SELECT a.vec_id AS src, b.vec_id AS dst, exp(-power(list_distance(a.v, b.v), 2) / ({SIGMA} * {SIGMA})) AS w
  FROM e a JOIN e b ON a.vec_id >= b.vec_id
  WHERE exp(-power(list_distance(a.v, b.v), 2) / ({SIGMA} * {SIGMA})) > {TOL})"""

FULL_SQL = EDGES_SQL + """,
full_edges AS MATERIALIZED (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst)"""

TRANSITION_SQL = FULL_SQL + """,
col_sums AS (SELECT dst, sum(w) AS s FROM full_edges GROUP BY dst),
by_column AS (SELECT src, f.dst, w / s AS w FROM full_edges f JOIN col_sums USING (dst)),
row_sums AS (SELECT src, sum(w) AS s FROM by_column GROUP BY src),
t AS MATERIALIZED (SELECT b.src, dst, w / s AS w FROM by_column b JOIN row_sums USING (src))"""

FOLDED_SQL = EDGES_SQL + """,
deg1 AS (SELECT id, sum(w) AS s FROM (SELECT src AS id, w FROM edges UNION ALL SELECT dst, w FROM edges WHERE src <> dst) GROUP BY id),
half1 AS (SELECT src, dst, w / s AS w FROM edges JOIN deg1 ON dst = id),
deg2 AS (SELECT id, sum(w) AS s FROM (SELECT src AS id, w FROM half1 UNION ALL SELECT dst, w FROM half1 WHERE src <> dst) GROUP BY id),
half2 AS (SELECT src, dst, w / s AS w FROM half1 JOIN deg2 ON src = id)"""

LABELS_SQL = """,
known AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label END AS label FROM e),
y0 AS MATERIALIZED (SELECT id, label, c, CASE WHEN label IS NULL THEN 0.5 WHEN label = c THEN 1.0 ELSE 0.0 END::DOUBLE AS y
       FROM known, (SELECT unnest(range(10)) AS c))"""


def steps_sql(n: int, transition: str = "t") -> str:
    """``n`` propagation steps as chained tables ``y1 .. yn``."""
    text = ""
    for i in range(1, n + 1):
        text += f""",
m{i} AS (SELECT src AS id, c, sum(w * y) AS y FROM {transition} JOIN y{i - 1} ON dst = id GROUP BY src, c),
y{i} AS MATERIALIZED (SELECT y0.id, label, y0.c, CASE WHEN label IS NULL THEN coalesce(m{i}.y, 0) ELSE y0.y END AS y
       FROM y0 LEFT JOIN m{i} ON y0.id = m{i}.id AND y0.c = m{i}.c)"""
    return text


BEST_SQL = """,
best AS (SELECT id, CAST(list_position(r, list_max(r)) - 1 AS DOUBLE) AS new_label, s
         FROM (SELECT id, list(y ORDER BY c) AS s, list(round(y, 9) ORDER BY c) AS r FROM {} GROUP BY id))"""


@query("j06_similarity_edges", f"WITH {EDGES_SQL} SELECT src, dst, round(w, 6) AS weight FROM edges")
def similarity(spark, sf_dir):
    return edges_of(spark, sf_dir).withColumn("weight", F.round("weight", 6))


_PART_SQL = """
s AS (SELECT avg(p_size) m0, stddev_samp(p_size) s0, avg(p_retailprice) m1, stddev_samp(p_retailprice) s1 FROM part),
e AS (SELECT p_partkey AS id, p_type, p_partkey % 5 = 0 AS is_known, (p_size - m0) / s0 AS a, (p_retailprice - m1) / s1 AS b FROM part, s),
edges AS MATERIALIZED (
  SELECT x.id AS src, y.id AS dst, exp(-(power(x.a - y.a, 2) + power(x.b - y.b, 2)) / (0.05 * 0.05)) AS w
  FROM e x JOIN e y ON x.id >= y.id
  WHERE exp(-(power(x.a - y.a, 2) + power(x.b - y.b, 2)) / (0.05 * 0.05)) > 0.01)"""


@query("j06_similarity_edges_grid", f"WITH {_PART_SQL} SELECT src, dst, round(w, 6) AS weight FROM edges")
def grid_similarity(spark, sf_dir):
    """Parts by size and price, standardised: two dimensions that cells prune."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    edges = similarity_edges(part, "p_partkey", ["p_size", "p_retailprice"], 0.05, 0.01)
    return edges.withColumn("weight", F.round("weight", 6))


@query(
    "o02_ordered_pairs",
    f"WITH {EDGES_SQL} SELECT src, dst, round(w, 6) AS weight FROM edges ORDER BY src, dst",
)
def ordered_pairs(spark, sf_dir):
    return edges_of(spark, sf_dir).withColumn("weight", F.round("weight", 6)).orderBy("src", "dst")


@query(
    "j07_symmetric_graph",
    "WITH " + VECTORS_SQL + """
SELECT a.vec_id AS src, b.vec_id AS dst, round(exp(-power(list_distance(a.v, b.v), 2) / 0.25), 6) AS weight
FROM e a, e b WHERE exp(-power(list_distance(a.v, b.v), 2) / 0.25) > 0.01""",
)
def complete_graph(spark, sf_dir):
    """Both directions and the diagonal, with a radius that leaves a vector few partners."""
    graph = symmetric_graph(vectors(spark, sf_dir), "vec_id", "point", 0.5, 0.01, standardize=False)
    return graph.withColumn("weight", F.round("weight", 6))


@query(
    "j08_matrix_product",
    """SELECT l_orderkey AS src, CAST(p_size AS BIGINT) AS dst, round(sum(l_quantity * p_retailprice), 2) AS weight
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def product(spark, sf_dir):
    """Orders x parts times parts x sizes."""
    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight")
    )
    b = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("src"),
        F.col("p_size").cast("bigint").alias("dst"),
        F.col("p_retailprice").alias("weight"),
    )
    return matrix_product(a, b).withColumn("weight", F.round("weight", 2))


@query(
    "j08_symmetric_product",
    f"""WITH {FULL_SQL}
SELECT src, CAST(label AS BIGINT) AS dst, round(sum(w), 6) AS weight FROM full_edges JOIN e ON dst = vec_id GROUP BY ALL""",
)
def symmetric_product(spark, sf_dir):
    """The mirrored triangle times the one-hot label matrix."""
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("src"), F.col("label").cast("bigint").alias("dst"), F.lit(1.0).alias("weight")
    )
    found = graph_of(spark, sf_dir).product(labels, known_labels(labels, "dst"))
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "j13_column_sums",
    f"WITH {TRANSITION_SQL} SELECT CAST(0 AS BIGINT) AS src, dst, round(sum(w), 6) AS weight FROM t GROUP BY dst",
)
def column_sums(spark, sf_dir):
    """A row of ones times the transition matrix."""
    ones = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.lit(1.0).alias("weight"))
    found = transition_of(graph_of(spark, sf_dir)).before(ones, ["weight"])
    return found.select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"), F.round("weight", 6).alias("weight"))


@query(
    "a10_degrees",
    f"WITH {FULL_SQL} SELECT src AS id, round(sum(w), 6) AS degree FROM full_edges GROUP BY src",
)
def node_degrees(spark, sf_dir):
    ones = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.lit(1.0).alias("degree"))
    return graph_of(spark, sf_dir).sums(ones, ["degree"]).withColumn("degree", F.round("degree", 6))


@query(
    "a11_mean_symmetric",
    """SELECT src, dst, round(avg(w), 6) AS weight
       FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_quantity AS w FROM lineitem
             UNION ALL SELECT l_partkey, l_suppkey, l_quantity FROM lineitem) GROUP BY ALL""",
)
def symmetrised(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight")
    )
    return mean_symmetric(entries).withColumn("weight", F.round("weight", 6))


@query("m16_transition_matrix", f"WITH {TRANSITION_SQL} SELECT src, dst, round(w, 6) AS weight FROM t")
def transition(spark, sf_dir):
    return transition_of(graph_of(spark, sf_dir)).entries().withColumn("weight", F.round("weight", 6))


@query("m16_folded_transition", f"WITH {FOLDED_SQL} SELECT src, dst, round(w, 6) AS weight FROM half2")
def folded(spark, sf_dir):
    return transition_of(graph_of(spark, sf_dir), "folded").entries().withColumn("weight", F.round("weight", 6))


@query(
    "j10_without_clamped",
    f"WITH {FULL_SQL} SELECT src, dst, round(w, 6) AS weight FROM full_edges WHERE src % 3 <> 0",
)
def unclamped(spark, sf_dir):
    free = F.when(F.col("label").isNull(), 1.0).alias("free")
    nodes = hidden(spark, sf_dir).select(F.col("vec_id").alias("id"), free, F.lit(1.0).alias("any"))
    kept = graph_of(spark, sf_dir).entries(nodes, "free", "any")
    return kept.withColumn("weight", F.round("weight", 6))


def _long(scores):
    """Score arrays as ``id, c, y`` rows."""
    return scores.select("id", F.posexplode("scores").alias("c", "y")).select(
        "id", "c", F.round("y", 6).alias("y")
    )


_LONG_SQL = "SELECT id, CAST(c AS INTEGER) AS c, round(y, 6) AS y FROM "


@query("f06_label_matrix", f"WITH {VECTORS_SQL} {LABELS_SQL} {_LONG_SQL} y0")
def first_scores(spark, sf_dir):
    return _long(label_matrix(hidden(spark, sf_dir), "vec_id", "label", CLASSES))


@query("m17_propagation_step", f"WITH {TRANSITION_SQL} {LABELS_SQL} {steps_sql(1)} {_LONG_SQL} y1")
def one_step(spark, sf_dir):
    scores = label_matrix(hidden(spark, sf_dir), "vec_id", "label", CLASSES)
    return _long(propagation_step(transition_of(graph_of(spark, sf_dir)), scores, CLASSES))


@query("m17_propagation_loop", f"WITH {TRANSITION_SQL} {LABELS_SQL} {steps_sql(4)} {_LONG_SQL} y4")
def loop(spark, sf_dir):
    scores = label_matrix(hidden(spark, sf_dir), "vec_id", "label", CLASSES)
    return _long(propagate(transition_of(graph_of(spark, sf_dir)), scores, CLASSES, max_iters=4))


_RESULT_SQL = "SELECT id AS vec_id, new_label, " + ", ".join(f"round(s[{c + 1}], 6) AS p{c}" for c in range(CLASSES)) + " FROM best"


def _result(filled):
    return filled.select(
        "vec_id", "new_label", *[F.round(F.get("probabilities", F.lit(c)), 6).alias(f"p{c}") for c in range(CLASSES)]
    )


@query(
    "m15_label_propagation",
    f"WITH {TRANSITION_SQL} {LABELS_SQL} {steps_sql(5)} {BEST_SQL.format('y5')} {_RESULT_SQL}",
)
def propagated(spark, sf_dir):
    return _result(
        label_propagation(
            hidden(spark, sf_dir), "vec_id", "label", "point",
            k=CLASSES, sigma=SIGMA, tol=TOL, max_iters=5, standardize=False,
        )
    )


_FOLDED_FULL_SQL = FOLDED_SQL + """,
t AS MATERIALIZED (SELECT src, dst, w FROM half2 UNION ALL SELECT dst, src, w FROM half2 WHERE src <> dst)"""


@query(
    "m15_label_propagation_folded",
    f"WITH {_FOLDED_FULL_SQL} {LABELS_SQL} {steps_sql(5)} {BEST_SQL.format('y5')} {_RESULT_SQL}",
)
def propagated_folded(spark, sf_dir):
    return _result(
        label_propagation(
            hidden(spark, sf_dir), "vec_id", "label", "point", k=CLASSES, sigma=SIGMA, tol=TOL,
            max_iters=5, standardize=False, normalization="folded",
        )
    )


_PART_LP_SQL = _PART_SQL + """,
full_edges AS MATERIALIZED (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst),
col_sums AS (SELECT dst, sum(w) AS s FROM full_edges GROUP BY dst),
by_column AS (SELECT src, f.dst, w / s AS w FROM full_edges f JOIN col_sums USING (dst)),
row_sums AS (SELECT src, sum(w) AS s FROM by_column GROUP BY src),
t AS MATERIALIZED (SELECT b.src, dst, w / s AS w FROM by_column b JOIN row_sums USING (src)),
names AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS c FROM (SELECT DISTINCT p_type FROM e WHERE is_known)),
known AS (SELECT id, CASE WHEN is_known THEN c END AS label FROM e JOIN names USING (p_type)),
y0 AS MATERIALIZED (SELECT id, label, c, CASE WHEN label IS NULL THEN 0.5 WHEN label = c THEN 1.0 ELSE 0.0 END::DOUBLE AS y
       FROM known, (SELECT c FROM names))"""


@query(
    "m15_label_propagation_grid",
    f"WITH {_PART_LP_SQL} {steps_sql(6)} {BEST_SQL.format('y6')} "
    "SELECT id AS p_partkey, p_type AS new_label, unnest(list_transform(s, lambda x: round(x, 6))) AS p, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS class FROM best JOIN names ON c = best.new_label",
)
def propagated_parts(spark, sf_dir):
    """Part types as text labels, one part in five known."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size", "p_retailprice")
    label = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type"))
    filled = label_propagation(
        part.withColumn("label", label), "p_partkey", "label", ["p_size", "p_retailprice"],
        sigma=0.05, tol=0.01, max_iters=6,
    )
    long = filled.select("p_partkey", "new_label", F.posexplode("probabilities").alias("class", "p"))
    return long.withColumn("p", F.round("p", 6))


@query(
    "j05_rows_with_scores",
    """SELECT doc_id, quality IS NOT NULL AS is_clamped, CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS s0,
              CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS s1
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rows_with_scores(spark, sf_dir):
    """Documents keep their row where no score exists."""
    scores = label_matrix(table(spark, sf_dir, "labels"), "doc_id", "quality", 2)
    documents = table(spark, sf_dir, "documents", "doc_id")
    joined = documents.join(scores.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = F.coalesce("is_clamped", F.lit(False)).alias("is_clamped")
    return joined.select("doc_id", known, *[F.get("scores", F.lit(c)).alias(f"s{c}") for c in (0, 1)])


@query(
    "j09_differently_named_keys",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def named_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).drop("o_custkey", "c_custkey")


@query(
    "j11_hidden_label_lookup",
    "SELECT doc_id, lang, quality AS hidden_label FROM documents LEFT JOIN labels USING (doc_id)",
)
def hidden_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("hidden_label"))
    return table(spark, sf_dir, "documents", "doc_id", "lang").join(labels, "doc_id", "left")


@query(
    "a12_class_priors",
    "SELECT label, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM embeddings GROUP BY label",
)
def priors(spark, sf_dir):
    return class_priors(table(spark, sf_dir, "embeddings", "label"), "label").withColumn(
        "prior", F.round("prior", 6)
    )


@query("a13_class_count", "SELECT l_linestatus, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS k FROM lineitem GROUP BY 1")
def classes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_linestatus", "l_linenumber")
    return class_counts(items, "l_linenumber", "l_linestatus")


@query("a14_label_counts", "SELECT label, count(*) AS count FROM embeddings GROUP BY label")
def counts(spark, sf_dir):
    return label_counts(table(spark, sf_dir, "embeddings", "label"), "label")


@query(
    "a15_largest_label",
    "SELECT max(CASE WHEN vec_id % 3 = 0 THEN label END)::DOUBLE AS largest FROM embeddings",
)
def largest_label(spark, sf_dir):
    label = F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("double")).otherwise(F.lit(float("nan")))
    masked = table(spark, sf_dir, "embeddings").select(label.alias("label"))
    return masked.filter(~F.isnan("label")).agg(F.max("label").alias("largest"))


_MASS_SQL = """,
p AS (SELECT label AS c, count(*) / sum(count(*)) OVER () AS prior FROM known WHERE label IS NOT NULL GROUP BY label),
weighed AS (SELECT id, y2.c, y * coalesce(prior, 0) AS y FROM y2 LEFT JOIN p USING (c))"""


@query(
    "m18_class_mass",
    f"WITH {TRANSITION_SQL} {LABELS_SQL} {steps_sql(2)} {_MASS_SQL} {_LONG_SQL} weighed",
)
def class_mass(spark, sf_dir):
    filled = label_propagation(
        hidden(spark, sf_dir), "vec_id", "label", "point",
        k=CLASSES, sigma=SIGMA, tol=TOL, max_iters=2, standardize=False,
    )
    weighed = class_mass_normalization(filled, CLASSES)
    return _long(weighed.select(F.col("vec_id").alias("id"), F.col("probabilities").alias("scores")))


@query(
    "m19_prior_weighed_label",
    f"WITH {TRANSITION_SQL} {LABELS_SQL} {steps_sql(2)} {_MASS_SQL} {BEST_SQL.format('weighed')} "
    "SELECT id AS vec_id, new_label FROM best",
)
def prior_weighed(spark, sf_dir):
    return label_propagation(
        hidden(spark, sf_dir), "vec_id", "label", "point", k=CLASSES, sigma=SIGMA, tol=TOL,
        max_iters=2, standardize=False, eval_type="max",
    ).select("vec_id", "new_label")
