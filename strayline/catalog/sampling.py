"""Sampling, hiding labels, error measures, profiles and logs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strayline.catalog.common import LINEITEM_FEATURES, query, spread, table, unit_hash_sql, vectors
from strayline.catalog.graphs import EDGES_SQL
from strayline.operators import logs
from strayline.operators.features import fit_scaler
from strayline.operators.metrics import area_under_roc, run_time_stats, threshold_curve
from strayline.operators.profiling import counters, table_size
from strayline.operators.sampling import (
    bernoulli_with_replacement,
    enlarge,
    hash_split,
    hide_labels,
    label_fractions,
    random_split,
    shrink,
    stratified_sample,
)
from strayline.plans import experiment
from strayline.roles import Roles


def _copies_sql(draw: str, mean: float) -> str:
    """SQL twin of ``poisson_copies``."""
    edges, term, total = [], math.exp(-mean), math.exp(-mean)
    while total < 1 - 1e-16 and len(edges) < mean + 40 * (1 + math.sqrt(mean)):
        edges.append(repr(total) + "::DOUBLE")
        term *= mean / len(edges)
        total += term
    return f"len(list_filter([{', '.join(edges)}], lambda x: x <= {draw}))"


_COPY = "(CAST(p_partkey AS VARCHAR) || '|' || CAST(c AS VARCHAR))"


@query(
    "x01_enlarge",
    f"""SELECT p_partkey, p_size + {unit_hash_sql(_COPY, 2)} AS p_size, p_retailprice + {unit_hash_sql(_COPY, 3)} AS p_retailprice
        FROM (SELECT *, unnest(range(1, 1 + {_copies_sql(unit_hash_sql('p_partkey', 1), 1.0)})) AS c FROM part)
        UNION ALL SELECT p_partkey, p_size, p_retailprice FROM part""",
)
def enlarged(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    return enlarge(part, 2 * part.count(), ["p_size", "p_retailprice"], 1, ["p_partkey"])


@query(
    "x02_shrink",
    f"""WITH h AS (SELECT vec_id, label, {unit_hash_sql('vec_id', 2)} AS h, count(*) OVER () // 4 * 1.0 / count(*) OVER () AS share FROM embeddings)
        SELECT vec_id, label FROM h
        WHERE h <= greatest(share, (SELECT min(h) FROM h AS i WHERE i.label = h.label))""",
)
def shrunk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label")
    return shrink(rows, rows.count() // 4, "label", "vec_id", seed=2)


@query(
    "x03_hide_labels",
    f"""SELECT vec_id, label, CASE WHEN {unit_hash_sql('vec_id', 3)} < 0.1 THEN CAST(label AS DOUBLE) END AS missing_label
        FROM embeddings""",
)
def labels_hidden(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label")
    masked = hide_labels(rows, "label", 0.1, id_col="vec_id", seed=3)
    shown = F.when(~F.isnan("missing_label"), F.col("missing_label"))
    return masked.withColumn("missing_label", shown)


@query("x03_hide_labels_numbered")
def labels_hidden_numbered(spark, sf_dir):
    """With a dense id of its own, and another fraction for two of the labels."""
    rows = table(spark, sf_dir, "documents", "lang", "source", "n_chars")
    numbered = rows.withColumn("long", F.when(F.col("n_chars") > 2000, 1).otherwise(0))
    return hide_labels(numbered, "long", per_label={0: 0.1, 1: 0.5})


@query(
    "x04_label_fractions",
    """SELECT DISTINCT label, CASE label WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 ELSE 0.0 END::DOUBLE AS fraction, 0.1::DOUBLE AS fixed
       FROM embeddings""",
)
def fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "label")
    fixed = label_fractions(rows, "label", 0.1).withColumnRenamed("fraction", "fixed")
    return label_fractions(rows, "label", per_label={1: 0.2, 2: 0.4}).join(fixed, "label")


_LINE_KEY = "(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"


@query(
    "x05_stratified_sample",
    f"""SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
        WHERE {unit_hash_sql(_LINE_KEY, 5)} < CASE l_returnflag WHEN 'A' THEN 0.1 WHEN 'N' THEN 0.2 WHEN 'R' THEN 0.3 ELSE 0 END""",
)
def stratified(spark, sf_dir):
    flags = {"A": 0.1, "N": 0.2, "R": 0.3}
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return stratified_sample(rows, "l_returnflag", flags, 5, ["l_orderkey", "l_linenumber"])


@query(
    "x06_hash_split",
    f"""SELECT o_orderkey, CASE WHEN {unit_hash_sql('o_orderkey', 6)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def split_by_hash(spark, sf_dir):
    train, test = hash_split(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 0.8, 6)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("x06_random_split", "SELECT count(*) AS n FROM orders")
def split_at_random(spark, sf_dir):
    """Both parts together are the whole table."""
    train, test = random_split(table(spark, sf_dir, "orders", "o_orderkey"), (0.66, 0.33), 6)
    return train.unionByName(test).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x07_sample_with_replacement",
    f"""SELECT l_orderkey, l_linenumber, l_quantity
        FROM (SELECT *, unnest(range({_copies_sql(unit_hash_sql(_LINE_KEY, 7), 0.1)})) FROM lineitem)""",
)
def with_replacement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return bernoulli_with_replacement(rows, 0.1, 7, ["l_orderkey", "l_linenumber"])


@query("x08_experiment")
def experiment_runs(spark, sf_dir):
    """Half the table and all of it, a tenth of the labels known, two runs each."""
    rows = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        F.col("prediction").alias("label"),
        *[F.get("point", F.lit(i)).alias(f"f{i}") for i in range(64)],
    )
    n = rows.count()
    roles = Roles.of("id", "label", [f"f{i}" for i in range(64)])
    found = experiment.run(
        rows, roles, [n // 2, n], 0.1, runs=2, sigma=0.6, max_iters=2, standardize=False, truth="label"
    )
    return experiment.run_statistics(found).drop("mean_seconds", "std_seconds")


def _runs_sql() -> str:
    """Two sizes and two runs each: every group ``g`` is a graph of its own, two steps."""
    step = ""
    for i in (1, 2):
        step += f""",
m{i} AS (SELECT g, src AS id, c, sum(w * y) AS y FROM t JOIN y{i - 1} USING (g) WHERE dst = y{i - 1}.id GROUP BY g, src, c),
y{i} AS MATERIALIZED (SELECT y0.g, y0.id, label, y0.c, CASE WHEN label IS NULL THEN coalesce(m{i}.y, 0) ELSE y0.y END AS y
       FROM y0 LEFT JOIN m{i} ON y0.g = m{i}.g AND y0.id = m{i}.id AND y0.c = m{i}.c)"""
    drawn = " UNION ALL ".join(
        f"""SELECT {g} AS g, CAST(n // {2 - g // 2} AS BIGINT) AS size, {g % 2} AS run, vec_id AS id, label AS truth, {unit_hash_sql('vec_id', 8 + g)} AS h FROM e, n"""
        for g in range(4)
    )
    hidden = "CASE g " + " ".join(f"WHEN {g} THEN {unit_hash_sql('id', 8 + g)}" for g in range(4)) + " END"
    return "WITH " + EDGES_SQL + f""",
n AS (SELECT count(*) AS n FROM e),
drawn AS ({drawn}),
rows_ AS MATERIALIZED (SELECT g, size, run, id, truth, CASE WHEN {hidden} < 0.2 THEN truth END AS label FROM drawn, n
  WHERE size = n OR h <= greatest(size / n, (SELECT min(h) FROM drawn d WHERE d.g = drawn.g AND d.truth = drawn.truth))),
f AS MATERIALIZED (SELECT a.g, src, dst, w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst)
  JOIN rows_ a ON a.id = src JOIN rows_ b ON b.id = dst AND a.g = b.g),
cs AS (SELECT g, dst, sum(w) AS s FROM f GROUP BY g, dst),
bc AS (SELECT g, src, dst, w / s AS w FROM f JOIN cs USING (g, dst)),
rs AS (SELECT g, src, sum(w) AS s FROM bc GROUP BY g, src),
t AS MATERIALIZED (SELECT g, src, dst, w / s AS w FROM bc JOIN rs USING (g, src)),
y0 AS MATERIALIZED (SELECT g, id, label, c, CASE WHEN label IS NULL THEN 0.5 WHEN label = c THEN 1.0 ELSE 0.0 END::DOUBLE AS y
       FROM rows_, (SELECT unnest(range(10)) AS c)){step},
best AS (SELECT g, id, list_position(r, list_max(r)) - 1 AS new_label FROM (SELECT g, id, list(round(y, 9) ORDER BY c) AS r FROM y2 GROUP BY g, id))
SELECT size, CAST(run AS INTEGER) AS run, count(*) AS n_rows, count(*) - count(label) AS n_hidden,
       round(avg(CASE WHEN new_label = truth THEN 0.0 ELSE 1.0 END), 6) AS error_rate
FROM rows_ JOIN best USING (g, id) GROUP BY size, run"""


@query("x08_runs_as_data", _runs_sql())
def runs_as_data(spark, sf_dir):
    """Half the table and all of it, a fifth of the labels known, two runs each, in one propagation."""
    rows = vectors(spark, sf_dir).withColumnsRenamed({"vec_id": "id", "prediction": "label"}).select("id", "label", "point")
    n = rows.count()
    roles = Roles.of("id", "label", ["point"])
    found = experiment.run_together(rows, roles, [n // 2, n], 0.2, 2, seed=8, sigma=0.6, max_iters=2, standardize=False)
    return found.withColumn("error_rate", F.round("error_rate", 6))


@query(
    "x09_repartition_sweep",
    "SELECT unnest([8, 80]) AS partitions, (SELECT count(*) FROM lineitem) AS n_rows",
)
def sweep(spark, sf_dir):
    """Rows of each run of the sweep; its seconds are for ``bench.py``."""
    items = table(spark, sf_dir, "lineitem", *LINEITEM_FEATURES)
    job = lambda df: df.select(fit_scaler(df, LINEITEM_FEATURES).vector().alias("v"))
    return experiment.repartition_sweep(items, job, [8, 80]).drop("seconds")


@query(
    "a16_table_size",
    """SELECT count(*) AS n_rows, round(sum(octet_length(encode(CAST(to_json({'n_nationkey': n_nationkey, 'c_custkey': c_custkey,
              'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR)))) / 1e6, 6) AS size_mb
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def size(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation", "n_nationkey")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", "c_custkey", "c_name", "c_mktsegment"
    )
    return table_size(joined).withColumn("size_mb", F.round("size_mb", 6))


@query(
    "a17_counters",
    """SELECT count(*) AS n_rows, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted,
              count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM lineitem""",
)
def named_counters(spark, sf_dir):
    return counters(
        table(spark, sf_dir, "lineitem", "l_discount", "l_returnflag"),
        discounted=F.col("l_discount") > 0.05,
        returned=F.col("l_returnflag") == "R",
    )


@query(
    "f17_run_time_stats",
    """SELECT event_type, round(avg(value), 6) AS mean_seconds, round(stddev_pop(value), 6) AS std_seconds
       FROM events GROUP BY event_type""",
)
def time_stats(spark, sf_dir):
    found = run_time_stats(table(spark, sf_dir, "events", "event_type", "value"), "value", "event_type")
    return found.select(
        "event_type",
        F.round("mean_seconds", 6).alias("mean_seconds"),
        F.round("std_seconds", 6).alias("std_seconds"),
    )


_CURVE_SQL = """
WITH s AS (SELECT l_quantity AS threshold, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS p,
                  count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS n FROM lineitem GROUP BY 1),
r AS (SELECT threshold, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
             sum(p) OVER () AS np, sum(n) OVER () AS nn
      FROM s WINDOW w AS (ORDER BY threshold DESC))"""


def returned(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), "l_quantity"
    )


@query(
    "m11_threshold_curve",
    _CURVE_SQL + """
SELECT threshold, tp, fp, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall,
       round(2 * tp / (tp + fp + np), 6) AS f_measure, round(fp / nn, 6) AS false_positive_rate FROM r""",
)
def curve(spark, sf_dir):
    found = threshold_curve(returned(spark, sf_dir), "label", "l_quantity", slices=16)
    rounded = ["precision", "recall", "f_measure", "false_positive_rate"]
    return found.select("threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "m11_area_under_roc",
    _CURVE_SQL + "SELECT round(sum(p * (nn - fp + n / 2)) / (max(np) * max(nn)), 6) AS auc FROM r",
)
def auc(spark, sf_dir):
    found = area_under_roc(returned(spark, sf_dir), "label", "l_quantity", slices=16)
    return found.select(F.round("auc", 6).alias("auc"))


def log_lines(spark, sf_dir, iteration="event_id"):
    """Three log lines per event: partitions, data and training time of one iteration."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    if isinstance(iteration, str):
        events = spread(events)
    else:
        # A log has its runs one after the other.
        events = events.orderBy(F.date_trunc("millisecond", "ts"), "event_id")
    head = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.lit(":INFO:__main__:Iteration: "),
        F.col(iteration) if isinstance(iteration, str) else iteration,
    )
    partitions = F.concat(head, F.lit(" - Number of partions: "), F.col("user_id") + 80)
    data = F.concat(head, F.lit(" - data: rows_"), F.col("event_id") * 10, F.lit(".parquet"))
    sign = F.when(F.col("event_id") % 2 == 0, "±").otherwise("+-")
    timing = F.concat(
        head, F.lit(" - Training model time: "), F.col("user_id"), F.lit("min "),
        F.format_string("%.2f", "value"), F.lit("s "), sign, F.lit(" "),
        F.col("event_id") % 1000, F.lit(" ms per loop (mean ± std. dev. of 7 runs)"),
    )
    noise = F.concat(head, F.lit(" finished"))
    return events.select(F.explode(F.array(partitions, data, timing, noise)).alias("value"))


@query(
    "f12_split_log_lines",
    """SELECT date_trunc('milliseconds', ts) AS ts, 'INFO' AS type, '__main__' AS function, event_id AS iteration, n_lines
       FROM events, (SELECT 3::BIGINT AS n_lines)""",
)
def split_log(spark, sf_dir):
    lines = logs.split_lines(log_lines(spark, sf_dir))
    iteration = F.trim(F.col("parts")["Iteration"]).cast("bigint").alias("iteration")
    return lines.groupBy("ts", "type", "function", iteration).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "f13_log_timings",
    """SELECT date_trunc('milliseconds', ts) AS ts, CAST(event_id AS VARCHAR) AS Iteration, round(user_id * 60 + value, 6)::DOUBLE AS mean,
              round((event_id % 1000) / 1000, 6)::DOUBLE AS std, event_id * 10 AS n, user_id + 80 AS partitions
       FROM events""",
)
def log_timings(spark, sf_dir):
    """Three records gathered by iteration."""
    found = logs.timings(logs.timing_records(log_lines(spark, sf_dir)))
    return found.drop("type", "function").withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )


@query(
    "f13_log_timings_of_runs",
    """WITH e AS (SELECT event_id, ts, user_id, value, event_id % 7 AS iteration, row_number() OVER (PARTITION BY event_id % 7 ORDER BY date_trunc('milliseconds', ts), event_id) AS run FROM events)
       SELECT date_trunc('milliseconds', ts) AS ts, CAST(CASE WHEN iteration < 3 THEN 0 ELSE event_id END AS VARCHAR) AS Iteration,
              round(user_id * 60 + value, 6)::DOUBLE AS mean, round((event_id % 1000) / 1000, 6)::DOUBLE AS std,
              event_id * 10 AS n, user_id + 80 AS partitions FROM e""",
)
def log_timings_of_runs(spark, sf_dir):
    """Three events in seven are runs of one iteration, told apart by their place in the log."""
    lines = log_lines(spark, sf_dir, F.when(F.col("event_id") % 7 < 3, 0).otherwise(F.col("event_id")))
    found = logs.timings(logs.timing_records(lines))
    return found.drop("type", "function").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "j12_join_log_records",
    """SELECT event_id AS iteration, event_id * 10 AS n, user_id + 80 AS partitions FROM events""",
)
def joined_records(spark, sf_dir):
    found = logs.timings(logs.split_lines(log_lines(spark, sf_dir)))
    return found.select(F.col("Iteration").cast("bigint").alias("iteration"), "n", "partitions")
