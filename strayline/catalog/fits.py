"""Models whose every step has an SQL twin: regression, mixtures, centers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayline.catalog.common import LINEITEM_FEATURES, query, table, unit_hash_sql, vectors
from strayline.catalog.models import PART_FEATURES, orders, parts
from strayline.lineage import cut
from strayline.operators.clustering import center_table
from strayline.operators.generative import checked_baseline, clusters_by_steps
from strayline.catalog.graphs import TRANSITION_SQL, steps_sql
from strayline.operators.lloyd import lloyd_steps, sweep_centers
from strayline.operators.mixture import apply_mixture, grouped_components, mixture_step
from strayline.operators.newton import cross_validated, fit_logistic, fold_measures, scored
from strayline.operators.metrics import classifier_curves
from strayline.operators.outliers import attach_centers, group_centers, measure
from strayline.operators.topics import table_topics
from strayline.operators.clustering import nearest_center
from strayline.operators.features import standardize
from strayline.plans import classification, semisupervised
from strayline.roles import Roles

REGRESSORS = ["o_totalprice", "month"]


def newton_sql(steps: int, rows: str = "z") -> str:
    """Chained tables ``b0 .. b<steps>`` of the weights of every model.

    ``rows(id, x0, x1, y, f)`` are the rows, ``models(m, lam, fold)`` the models, which do not
    see their fold. Each step solves the three normal equations by determinants.
    """
    text = """,
b0 AS (SELECT m, lam, fold, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM models)"""
    for i in range(1, steps + 1):
        text += f""",
p{i} AS (SELECT b.*, x0, x1, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))) AS p
         FROM {rows} z JOIN b{i - 1} b ON fold IS NULL OR f <> fold WHERE y IS NOT NULL),
s{i} AS (SELECT m, lam, fold, w0, w1, w2,
           sum((y - p) * x0) / count(*) - lam * w0 AS g0, sum((y - p) * x1) / count(*) - lam * w1 AS g1, sum(y - p) / count(*) AS g2,
           sum(p * (1 - p) * x0 * x0) / count(*) + lam AS a, sum(p * (1 - p) * x0 * x1) / count(*) AS b, sum(p * (1 - p) * x0) / count(*) AS c,
           sum(p * (1 - p) * x1 * x1) / count(*) + lam AS d, sum(p * (1 - p) * x1) / count(*) AS e, sum(p * (1 - p)) / count(*) AS h
         FROM p{i} GROUP BY m, lam, fold, w0, w1, w2),
b{i} AS (SELECT m, lam, fold,
           w0 + (g0 * (d * h - e * e) - b * (g1 * h - e * g2) + c * (g1 * e - d * g2)) / (a * (d * h - e * e) - b * (b * h - c * e) + c * (b * e - c * d)) AS w0,
           w1 + (a * (g1 * h - e * g2) - g0 * (b * h - c * e) + c * (b * g2 - c * g1)) / (a * (d * h - e * e) - b * (b * h - c * e) + c * (b * e - c * d)) AS w1,
           w2 + (a * (d * g2 - e * g1) - b * (b * g2 - c * g1) + g0 * (b * e - c * d)) / (a * (d * h - e * e) - b * (b * h - c * e) + c * (b * e - c * d)) AS w2
         FROM s{i})"""
    return text


def _orders_sql(y: str = "y", fold: str = "0") -> str:
    return f"""
o AS (SELECT o_orderkey AS id, o_totalprice AS price, CAST(month(o_orderdate) AS DOUBLE) AS mon,
             CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM orders),
s AS (SELECT avg(price) m0, stddev_samp(price) s0, avg(mon) m1, stddev_samp(mon) s1 FROM o),
z AS (SELECT id, price, mon, (price - m0) / s0 AS x0, (mon - m1) / s1 AS x1, {y} AS y, {fold} AS f, y AS truth FROM o, s)"""


_ONE_MODEL = ", models AS (SELECT 0 AS m, {lam}::DOUBLE AS lam, NULL::INTEGER AS fold)"


@query(
    "m08_newton_regression",
    f"""WITH {_orders_sql()} {_ONE_MODEL.format(lam=0.001)} {newton_sql(4)}
SELECT id AS o_orderkey, truth AS finished, round(1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))), 6) AS probability,
       CASE WHEN w0 * x0 + w1 * x1 + w2 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM z, b4""",
)
def newton_regression(spark, sf_dir):
    rows = orders(spark, sf_dir)
    model = fit_logistic(rows, REGRESSORS, "finished", (0.001,), steps=4)[0]
    found = scored(rows, model)
    return found.select("o_orderkey", "finished", F.round(F.get("probability", F.lit(1)), 6).alias("probability"), "prediction")


@query(
    "m08_newton_steps",
    f"WITH {_orders_sql()} {_ONE_MODEL.format(lam=0.001)} {newton_sql(4)} "
    + " UNION ALL ".join(f"SELECT {i} AS step, round(w0, 6) AS price, round(w1, 6) AS month, round(w2, 6) AS intercept FROM b{i}" for i in range(1, 5)),
)
def newton_path(spark, sf_dir):
    """Weights of the standardised features after each step."""
    model = fit_logistic(orders(spark, sf_dir), REGRESSORS, "finished", (0.001,), steps=4)[0]
    rows = [(i, *[float(w) for w in weights]) for i, weights in enumerate(model.path, 1)]
    found = spark.createDataFrame(rows, "step int, price double, month double, intercept double")
    return found.select("step", *[F.round(c, 6).alias(c) for c in ("price", "month", "intercept")])


_TRAIN = f"CASE WHEN {unit_hash_sql('o.id', 3)} < 0.8 THEN y END"


@query(
    "p16_newton_projection",
    f"""WITH {_orders_sql(_TRAIN)} {_ONE_MODEL.format(lam=0.0)} {newton_sql(5)},
t AS (SELECT z.*, w0 * x0 + w1 * x1 + w2 AS odds FROM z, b5 WHERE y IS NULL)
SELECT id AS o_orderkey, price AS o_totalprice, mon AS month, truth AS finished, round(-odds, 6) AS raw_0, round(odds, 6) AS raw_1,
       round(1 - 1 / (1 + exp(-odds)), 6) AS p_0, round(1 / (1 + exp(-odds)), 6) AS p_1,
       CASE WHEN odds > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM t""",
)
def newton_projection(spark, sf_dir):
    """The job by Newton steps: rows held out by a hash of their key, with all result columns.

    Training and held-out rows are standardised alike, by the whole table.
    """
    roles = Roles.of("o_orderkey", "finished", REGRESSORS)
    found = classification.run(orders(spark, sf_dir), roles, "newton", split_key="o_orderkey", seed=3, steps=5)
    each = {f"{n}_{i}": F.round(F.get(c, F.lit(i)), 6) for c, n in (("rawPrediction", "raw"), ("probability", "p")) for i in (0, 1)}
    return found.withColumns(each).select("o_orderkey", *REGRESSORS, "finished", *each, "prediction")


_FOLDS_SQL = f"CAST(least(floor(({unit_hash_sql('{}', 5)}) * 2), 1) AS INTEGER)"
_GRID_SQL = """,
models AS (SELECT row_number() OVER () AS m, * FROM (SELECT unnest([0.01, 0.1])::DOUBLE AS lam), (SELECT unnest([0, 1]) AS fold))"""
_MEASURES_SQL = """,
q AS (SELECT lam, fold, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))) AS p FROM z JOIN {last} ON f = fold WHERE y IS NOT NULL),
measures AS (SELECT lam AS regularisation, fold, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss,
                    avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM q GROUP BY ALL)"""


@query(
    "m09_fold_measures",
    f"""WITH {_orders_sql(fold=_FOLDS_SQL.format('o.id'))} {_GRID_SQL} {newton_sql(4)} {_MEASURES_SQL.format(last='b4')}
SELECT regularisation, fold, n, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy FROM measures""",
)
def fold_scores(spark, sf_dir):
    """Two folds by key and two regularisations, all models in the same passes."""
    _, scores = cross_validated(orders(spark, sf_dir), REGRESSORS, "finished", ["o_orderkey"], (0.01, 0.1), 2, 5, steps=4)
    found = fold_measures(scores, "finished")
    return found.select("regularisation", "fold", "n", F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"))


_PARTS_SQL = """
s AS (SELECT avg(p_size) m0, stddev_samp(p_size) s0, avg(p_retailprice) m1, stddev_samp(p_retailprice) s1 FROM part),
z AS (SELECT p_partkey AS id, p_size, (p_size - m0) / s0 AS x0, (p_retailprice - m1) / s1 AS x1{} FROM part, s)"""


@query(
    "m14_newton_baseline",
    "WITH " + _PARTS_SQL.format(f""",
       CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END END::DOUBLE AS y,
       {_FOLDS_SQL.format('p_partkey')} AS f""") + """,
models AS (SELECT row_number() OVER () AS m, * FROM (SELECT unnest([0.1, 0.01])::DOUBLE AS lam), (SELECT unnest([0, 1, NULL]) AS fold))"""
    + newton_sql(6) + _MEASURES_SQL.format(last="b6") + """,
best AS (SELECT regularisation FROM measures GROUP BY 1 ORDER BY avg(log_loss), 1 LIMIT 1)
SELECT id AS p_partkey, y AS used_label, round(1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))), 6) AS probability,
       CASE WHEN w0 * x0 + w1 * x1 + w2 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
FROM z, b6, best WHERE fold IS NULL AND lam = regularisation""",
)
def newton_baseline(spark, sf_dir):
    """Regularisation by folds of the known labels, then a fit on all of them."""
    known = F.when(F.col("p_partkey") % 4 == 0, F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "part", "p_partkey", *PART_FEATURES).withColumn("used_label", known)
    found = checked_baseline(rows, PART_FEATURES, "used_label", ["p_partkey"], folds=2, seed=5, steps=6)
    return found.select("p_partkey", "used_label", F.round(F.get("probability", F.lit(1)), 6).alias("probability"), "prediction")


def mixture_sql(steps: int) -> str:
    """Chained tables ``c0 .. c<steps>`` of a mixture's components over ``z(id, p_size, x0, x1)``."""
    moments = """count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, covar_pop(x0, x0) AS v00, covar_pop(x0, x1) AS v01, covar_pop(x1, x1) AS v11"""
    text = f""",
c0 AS (SELECT k, n / sum(n) OVER () AS w, m0, m1, v00, v01, v11 FROM (SELECT CAST((p_size - 1) // 17 AS INTEGER) AS k, {moments} FROM z GROUP BY 1))"""
    for i in range(1, steps + 1):
        text += f"""{shares_sql(i - 1)},
t{i} AS (SELECT k, sum(r) AS n, sum(r * x0) / sum(r) AS m0, sum(r * x1) / sum(r) AS m1,
           sum(r * x0 * x0) / sum(r) AS q00, sum(r * x0 * x1) / sum(r) AS q01, sum(r * x1 * x1) / sum(r) AS q11 FROM r{i - 1} GROUP BY k),
c{i} AS (SELECT k, n / sum(n) OVER () AS w, m0, m1, q00 - m0 * m0 AS v00, q01 - m0 * m1 AS v01, q11 - m1 * m1 AS v11 FROM t{i})"""
    return text


def shares_sql(i: int) -> str:
    return f""",
d{i} AS (SELECT id, x0, x1, k, w / (2 * pi() * sqrt(v00 * v11 - v01 * v01)) * exp(-0.5 * (v11 * (x0 - m0) * (x0 - m0)
           - 2 * v01 * (x0 - m0) * (x1 - m1) + v00 * (x1 - m1) * (x1 - m1)) / (v00 * v11 - v01 * v01)) AS p FROM z, c{i}),
r{i} AS (SELECT id, x0, x1, k, p / sum(p) OVER (PARTITION BY id) AS r FROM d{i})"""


def _mixture(spark, sf_dir, steps: int):
    """Parts, their first components by size, and the components after each step."""
    rows = cut(parts(spark, sf_dir).select("p_partkey", "p_size", "scaled_features"))
    path = [grouped_components(rows, "scaled_features", F.floor((F.col("p_size") - 1) / 17), 3)]
    for _ in range(steps):
        path.append(mixture_step(rows, "scaled_features", path[-1])[0])
    return rows, path


_COMPONENT = ("weight", "mean_0", "mean_1", "cov_00", "cov_01", "cov_11")


def _flat(components):
    """Columns of a component table with its numbers side by side."""
    at = lambda c, *places: F.get(F.get(c, F.lit(places[0])), F.lit(places[1])) if len(places) > 1 else F.get(c, F.lit(places[0]))
    each = [F.col("weight"), at("centers", 0), at("centers", 1), at("covariance", 0, 0), at("covariance", 0, 1), at("covariance", 1, 1)]
    return components.select("*", *[F.round(c, 6).alias(n) for c, n in zip(each, _COMPONENT)][1:]).withColumn("weight", F.round("weight", 6))


_FLAT_SQL = "round(w, 6) AS weight, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(v00, 6) AS cov_00, round(v01, 6) AS cov_01, round(v11, 6) AS cov_11"


@query(
    "m01_mixture_steps",
    "WITH " + _PARTS_SQL.format("") + mixture_sql(2) + " "
    + " UNION ALL ".join(f"SELECT {i} AS step, k AS prediction, {_FLAT_SQL} FROM c{i}" for i in range(3)),
)
def mixture_path(spark, sf_dir):
    """Components of a mixture of three, at the start and after each of two steps."""
    _, path = _mixture(spark, sf_dir, 2)
    found = None
    for step, components in enumerate(path):
        rows = _flat(components.table(spark)).select(F.lit(step).alias("step"), "prediction", *_COMPONENT)
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "j01_attach_covariance",
    "WITH " + _PARTS_SQL.format("") + mixture_sql(2) + shares_sql(2) + f""",
own AS (SELECT id, CAST(arg_max(k, r) AS INTEGER) AS k, max(r) AS r FROM r2 GROUP BY id)
SELECT id AS p_partkey, k AS prediction, round(r, 6) AS share, {_FLAT_SQL} FROM own JOIN c2 USING (k)""",
)
def rows_with_covariance(spark, sf_dir):
    """Each part with its component's weight, mean and covariance."""
    rows, path = _mixture(spark, sf_dir, 2)
    found = apply_mixture(rows, "scaled_features", path[-1])
    joined = _flat(attach_centers(found, path[-1].table(spark)))
    return joined.select("p_partkey", "prediction", F.round(F.array_max("probability"), 6).alias("share"), *_COMPONENT)


def lloyd_sql(steps: int, dims: int) -> str:
    """Chained tables ``c0 .. c<steps>`` of every model's centers over ``z(id, x0, ..)``; ``c0(m, k, x0, ..)`` is given."""
    gaps = " + ".join(f"(z.x{i} - c.x{i}) * (z.x{i} - c.x{i})" for i in range(dims))
    text = ""
    for s in range(1, steps + 1):
        means = ", ".join(f"avg(x{i}) AS x{i}" for i in range(dims))
        kept = ", ".join(f"coalesce(n.x{i}, c.x{i}) AS x{i}" for i in range(dims))
        text += f"""{assigned_sql(s, s - 1, gaps)},
n{s} AS (SELECT m, k, count(*) AS n, {means} FROM a{s} JOIN z USING (id) GROUP BY m, k),
c{s} AS MATERIALIZED (SELECT c.m, c.k, coalesce(n.n, 0) AS n, {kept} FROM c{s - 1} c LEFT JOIN n{s} n USING (m, k))"""
    return text


def assigned_sql(name, centers: int, gaps: str) -> str:
    return f""",
a{name} AS MATERIALIZED (SELECT m, id, arg_min(k, {gaps}) AS k, min({gaps}) AS d2 FROM z, c{centers} c GROUP BY m, id)"""


_GAPS = {d: " + ".join(f"(z.x{i} - c.x{i}) * (z.x{i} - c.x{i})" for i in range(d)) for d in (2, 4)}
_ITEMS_SQL = """
s AS (SELECT avg(l_quantity) m0, stddev_samp(l_quantity) s0, avg(l_extendedprice) m1, stddev_samp(l_extendedprice) s1,
             avg(l_discount) m2, stddev_samp(l_discount) s2, avg(l_tax) m3, stddev_samp(l_tax) s3 FROM lineitem),
z AS MATERIALIZED (SELECT row_number() OVER () AS id, l_linenumber, (l_quantity - m0) / s0 AS x0, (l_extendedprice - m1) / s1 AS x1,
             (l_discount - m2) / s2 AS x2, (l_tax - m3) / s3 AS x3 FROM lineitem, s),
c0 AS (SELECT 0 AS m, CAST(l_linenumber - 1 AS INTEGER) AS k, avg(x0) x0, avg(x1) x1, avg(x2) x2, avg(x3) x3 FROM z GROUP BY l_linenumber)"""


@query(
    "m02_lloyd_steps",
    f"WITH {_ITEMS_SQL} {lloyd_sql(3, 4)} "
    "SELECT k AS prediction, n, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3 FROM c3",
)
def centers_after_steps(spark, sf_dir):
    """Line items from the means of their line numbers: centers after three steps."""
    items = table(spark, sf_dir, "lineitem", "l_linenumber", *LINEITEM_FEATURES)
    rows = cut(standardize(items, LINEITEM_FEATURES).select("l_linenumber", "scaled_features"))
    first = group_centers(rows, "l_linenumber", "scaled_features", width=4).orderBy("l_linenumber").collect()
    last = lloyd_steps(rows, "scaled_features", {0: [r["centers"] for r in first]}, 3)[-1][0]
    found = [(k, int(n), *[float(x) for x in c]) for k, (n, c) in enumerate(zip(last.sizes, last.centers))]
    made = spark.createDataFrame(found, "prediction int, n bigint, x0 double, x1 double, x2 double, x3 double")
    return made.select("prediction", "n", *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(4)])


def _starts(rows, k: int):
    """The vectors of the parts with the lowest keys."""
    return [r["scaled_features"] for r in rows.orderBy("p_partkey").limit(k).collect()]


_START_SQL = """,
ranked AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS k, x0, x1 FROM z QUALIFY k < 4)"""


@query(
    "m04_lloyd_predictions",
    "WITH " + _PARTS_SQL.format("") + _START_SQL + ", c0 AS (SELECT 0 AS m, * FROM ranked)" + lloyd_sql(5, 2) + assigned_sql("_last", 5, _GAPS[2]) + """
SELECT id AS p_partkey, a.k AS prediction, round(c.x0, 6) AS center_0, round(c.x1, 6) AS center_1, round(sqrt(d2), 6) AS distance
FROM a_last a JOIN c5 c ON a.k = c.k""",
)
def lloyd_predictions(spark, sf_dir):
    """Parts with the number, the place and the distance of their center after five steps."""
    rows = cut(parts(spark, sf_dir).select("p_partkey", "scaled_features"))
    centers = lloyd_steps(rows, "scaled_features", {0: _starts(rows, 4)}, 5)[-1][0].centers.tolist()
    found = attach_centers(nearest_center(rows, centers), center_table(spark, centers))
    at = lambda c, i: F.get(c, F.lit(i))
    gap = F.sqrt(sum(F.pow(at("scaled_features", i) - at("centers", i), 2) for i in (0, 1)))
    places = [F.round(at("centers", i), 6).alias(f"center_{i}") for i in (0, 1)]
    return found.select("p_partkey", "prediction", *places, F.round(gap, 6).alias("distance"))


@query(
    "m05_lloyd_centers",
    "WITH " + _PARTS_SQL.format("") + _START_SQL + ", c0 AS (SELECT 0 AS m, * FROM ranked)" + lloyd_sql(5, 2)
    + " SELECT k AS prediction, n, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM c5",
)
def lloyd_centers(spark, sf_dir):
    rows = cut(parts(spark, sf_dir).select("p_partkey", "scaled_features"))
    last = lloyd_steps(rows, "scaled_features", {0: _starts(rows, 4)}, 5)[-1][0]
    made = [(k, int(n), float(c[0]), float(c[1])) for k, (n, c) in enumerate(zip(last.sizes, last.centers))]
    found = spark.createDataFrame(made, "prediction int, n bigint, x0 double, x1 double")
    return found.select("prediction", "n", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def _sweep_sql() -> str:
    """Silhouette and cost of models of 2 and 3 clusters after 3 and 6 steps."""
    text = "WITH " + _PARTS_SQL.format("") + _START_SQL + """,
c0 AS (SELECT m, k, x0, x1 FROM ranked, (SELECT unnest([2, 3]) AS m) WHERE k < m)""" + lloyd_sql(6, 2)
    for i in (3, 6):
        text += assigned_sql(f"_{i}", i, _GAPS[2]) + f""",
u{i} AS (SELECT m, k, count(*) AS n, avg(x0) AS y0, avg(x1) AS y1, avg(x0 * x0 + x1 * x1) AS q FROM a_{i} JOIN z USING (id) GROUP BY m, k),
v{i} AS (SELECT a.m, id, a.k = u.k AS own, n, x0 * x0 + x1 * x1 + q - 2 * (x0 * y0 + x1 * y1) AS away FROM a_{i} a JOIN z USING (id) JOIN u{i} u ON a.m = u.m),
w{i} AS (SELECT m, id, max(n) FILTER (own) AS n, max(away * n / greatest(n - 1, 1)) FILTER (own) AS inside, min(away) FILTER (NOT own) AS outside FROM v{i} GROUP BY m, id),
q{i} AS (SELECT m, avg(CASE WHEN n > 1 AND outside IS NOT NULL THEN (outside - inside) / greatest(outside, inside) ELSE 0 END) AS silhouette FROM w{i} GROUP BY m),
e{i} AS (SELECT m, sum(d2) AS cost FROM a_{i} GROUP BY m)"""
    return text + " " + " UNION ALL ".join(
        f"SELECT CAST(m AS INTEGER) AS k, {i} AS max_iter, round(silhouette, 6) AS silhouette, round(cost, 4) AS cost FROM q{i} JOIN e{i} USING (m)" for i in (3, 6)
    )


@query("m12_sweep_in_shared_passes", _sweep_sql())
def shared_sweep(spark, sf_dir):
    rows = cut(parts(spark, sf_dir).select("p_partkey", "scaled_features"))
    found = sweep_centers(rows, "scaled_features", _starts(rows, 3), (2, 3), (3, 6))
    return found.select("k", "max_iter", F.round("silhouette", 6).alias("silhouette"), F.round("cost", 4).alias("cost"))


def _topics_sql(k: int, steps: int) -> str:
    """Shares of words by topic, first by a hash, then by document and word; long tables."""
    first = f"CAST('0x' || substr(md5(CAST(t AS VARCHAR) || '|' || CAST(doc AS VARCHAR) || '|' || word), 1, 12) AS BIGINT) / 281474976710656.0 + 0.5"
    text = f"""
WITH words AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM documents),
counts AS MATERIALIZED (SELECT doc, word, count(*) AS n FROM words GROUP BY ALL),
w0 AS (SELECT doc, word, n, t, {first} AS w FROM counts, (SELECT unnest(range({k})) AS t)),
s0 AS MATERIALIZED (SELECT doc, word, t, n * w / sum(w) OVER (PARTITION BY doc, word) AS s FROM w0)"""
    for i in range(1, steps + 1):
        text += f""",
x{i} AS MATERIALIZED (SELECT word, t, sum(s) AS s FROM s{i - 1} GROUP BY word, t),
d{i} AS MATERIALIZED (SELECT doc, t, sum(s) AS s FROM s{i - 1} GROUP BY doc, t),
t{i} AS (SELECT t, sum(s) + 0.01 * count(*) AS total FROM x{i} GROUP BY t),
w{i} AS (SELECT c.doc, c.word, n, x.t, (x.s + 0.01) / total * (d.s + 0.1) AS w
  FROM counts c JOIN x{i} x USING (word) JOIN d{i} d ON d.doc = c.doc AND d.t = x.t JOIN t{i} t ON t.t = x.t),
s{i} AS MATERIALIZED (SELECT doc, word, t, n * w / sum(w) OVER (PARTITION BY doc, word) AS s FROM w{i})"""
    return text + f""",
l AS (SELECT doc, t, sum(s) + 0.1 AS s FROM s{steps} GROUP BY doc, t),
b AS (SELECT doc, CAST(arg_max(t, s) AS INTEGER) AS topic, round(max(s) / sum(s), 4) AS weight FROM l GROUP BY doc)
SELECT doc_id, topic, weight FROM documents LEFT JOIN b ON doc_id = doc"""


@query("m03_topic_steps", _topics_sql(5, 2))
def topic_table(spark, sf_dir):
    """Topics of documents after two steps over tables of words and documents."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = table_topics(documents, "doc_id", "text", k=5, steps=2)
    return found.select("doc_id", "topic", F.round(F.array_max("topic_weights"), 4).alias("weight"))


@query(
    "m07_lloyd_report",
    "WITH " + _PARTS_SQL.format("") + _START_SQL + ", c0 AS (SELECT 0 AS m, * FROM ranked)" + lloyd_sql(5, 2) + assigned_sql("_last", 5, _GAPS[2]) + """,
d AS (SELECT k + 1 AS prediction, sqrt(d2) AS distance FROM a_last),
b AS (SELECT prediction, avg(distance) + 2 * stddev_pop(distance) AS boundary FROM d GROUP BY prediction)
SELECT prediction, count(*) AS amount, count(*) FILTER (distance > boundary) AS amount_outlier,
       round(100 * count(*) FILTER (distance > boundary) / count(*), 3) AS percentage_outlier
FROM d JOIN b USING (prediction) GROUP BY prediction""",
)
def lloyd_report(spark, sf_dir):
    """The outlier job from given centers: clusters, distances, boundaries, report."""
    rows = cut(parts(spark, sf_dir).select("p_partkey", "scaled_features"))
    centers = lloyd_steps(rows, "scaled_features", {0: _starts(rows, 4)}, 5)[-1][0].centers.tolist()
    joined = attach_centers(nearest_center(rows, centers), center_table(spark, centers))
    return measure(joined, ["p_partkey"], width=2).report()


_HALF = "CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END END::DOUBLE"


@query(
    "m13_clusters_by_steps",
    "WITH " + _PARTS_SQL.format(f", {_HALF} AS known") + """,
c0 AS (SELECT 0 AS m, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS k, x0, x1 FROM z QUALIFY k < 2)"""
    + lloyd_sql(5, 2) + assigned_sql("_last", 5, _GAPS[2]) + """,
y AS (SELECT z.id, x0, x1, known, CAST(k AS DOUBLE) AS y, 0 AS f FROM z JOIN a_last a ON z.id = a.id)""" + _ONE_MODEL.format(lam=0.01)
    + newton_sql(5, "y") + """,
q AS (SELECT id, known, CAST(y AS INTEGER) AS cluster, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))) AS p,
             CASE WHEN w0 * x0 + w1 * x1 + w2 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM y, b5),
n AS (SELECT prediction, known, count(*) AS n FROM q WHERE known IS NOT NULL GROUP BY ALL),
l AS (SELECT prediction, arg_max(known, n * 10 - known) AS majority_label FROM n GROUP BY prediction)
SELECT id AS p_partkey, cluster, round(p, 6) AS probability, q.prediction, majority_label FROM q LEFT JOIN l ON q.prediction = l.prediction""",
)
def generative_by_steps(spark, sf_dir):
    """Every part's cluster, predicted cluster and the most frequent known label of that."""
    known = F.when(F.col("p_partkey") % 4 == 0, F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "part", "p_partkey", *PART_FEATURES).withColumn("known", known)
    start = _starts(standardize(rows, PART_FEATURES), 2)
    found = clusters_by_steps(rows, PART_FEATURES, "known", start, 0.01, 5, 5)
    p = F.round(F.get("probability", F.lit(1)), 6).alias("probability")
    return found.select("p_partkey", "cluster", p, "prediction", "majority_label")


@query(
    "m15_semisupervised_labels",
    f"""WITH {TRANSITION_SQL},
y0 AS MATERIALIZED (SELECT id, label, c, CASE WHEN label IS NULL THEN 0.5 WHEN label = c THEN 1.0 ELSE 0.0 END::DOUBLE AS y
       FROM (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label % 2 END AS label FROM e), (SELECT unnest(range(2)) AS c)) {steps_sql(3)}
SELECT id AS vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, CASE WHEN round(p1, 9) > round(p0, 9) THEN 1.0 ELSE 0.0 END::DOUBLE AS new_label
FROM (SELECT id, max(y) FILTER (c = 0) AS p0, max(y) FILTER (c = 1) AS p1 FROM y3 GROUP BY id)""",
)
def semisupervised_labels(spark, sf_dir):
    """The label propagation job with two classes: scores and labels of every row."""
    label = F.when(F.col("vec_id") % 3 == 0, (F.col("prediction") % 2).cast("double"))
    rows = vectors(spark, sf_dir).select("vec_id", label.alias("label"), "point")
    filled = semisupervised.run(rows, Roles.of("vec_id", "label", ["point"]), sigma=0.6, max_iters=3, standardize=False)
    return filled.select("vec_id", *[F.round(F.get("probabilities", F.lit(c)), 6).alias(f"p{c}") for c in (0, 1)], "new_label")


@query(
    "m11_newton_curves",
    f"""WITH {_orders_sql()} {_ONE_MODEL.format(lam=0.001)} {newton_sql(4)},
q AS (SELECT round(1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))), 4) AS threshold, y FROM z, b4),
hits AS (SELECT threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM q GROUP BY 1),
r AS (SELECT threshold, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn
      FROM hits WINDOW w AS (ORDER BY threshold DESC)),
k AS (SELECT threshold, tp / (tp + fp) AS pre, tp / np AS rec, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + np) END AS f, fp / nn AS fpr FROM r)
SELECT 'f_measure' AS curve, threshold, threshold AS x, round(f, 6) AS y FROM k
UNION ALL SELECT 'precision', threshold, threshold, round(pre, 6) FROM k
UNION ALL SELECT 'recall', threshold, threshold, round(rec, 6) FROM k
UNION ALL SELECT 'pr', threshold, round(rec, 6), round(pre, 6) FROM k
UNION ALL SELECT 'roc', threshold, round(fpr, 6), round(rec, 6) FROM k
UNION ALL SELECT 'auc', NULL, NULL, round(sum(p * (nn - fp + n / 2)) / (max(np) * max(nn)), 6) FROM r""",
)
def newton_curves(spark, sf_dir):
    """All five curves of a regression in Newton steps, and its area, by probabilities of four digits."""
    rows = orders(spark, sf_dir)
    found = scored(rows, fit_logistic(rows, REGRESSORS, "finished", (0.001,), steps=4)[0])
    probability = F.round(F.get("probability", F.lit(1)), 4).alias("probability")
    curves = classifier_curves(found.select("finished", probability), "finished", "probability")
    return curves.select("curve", "threshold", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
