"""Workflow logs: lines to columns, columns to timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayline.functions.durations import to_seconds
from strayline.lineage import cut
from strayline.operators.row_ids import add_dense_id

# The log format.
# Start of a line: a timestamp of 23 characters, then level and function.
_LINE = r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d{3}:[^:]*:[^:]*:"
_TIMESTAMP_LENGTH = 23


def _once(value: Column) -> Column:
    """Work a value out once: what reads it later cannot repeat its expression."""
    return F.explode(F.array(value))


def _pairs(lines: DataFrame, column: str) -> DataFrame:
    """``ts, _after, _pairs`` of the lines that are records: time, head and ``key:value`` pieces."""
    text = F.col(column)
    time = F.try_to_timestamp(F.substring(text, 1, _TIMESTAMP_LENGTH), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    after = F.split(F.substring(text, _TIMESTAMP_LENGTH + 2, 1 << 30), ":", 3)
    fields = lines.filter(text.rlike(_LINE)).select(time.cast("timestamp_ntz").alias("ts"), _once(after).alias("_after"))
    pieces = F.split(F.get("_after", F.lit(2)), " - ", -1)
    split_up = F.transform(pieces, lambda piece: F.split(piece, ":"))
    pair = lambda p: F.size(p) == 2
    return (
        fields.select("ts", "_after", _once(split_up).alias("_all"))
        .filter((F.size("_all") >= 2) & pair(F.get("_all", F.lit(0))) & pair(F.get("_all", F.lit(1))))
        .select("ts", "_after", _once(F.filter("_all", pair)).alias("_pairs"))
    )


def split_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``ts, type, function, parts`` of each log line.

    ``parts`` maps every ``key:value`` piece; `` - `` separates them. Lines with
    fewer than two such pieces are dropped, and so are those whose first two are not
    of that kind. Of pieces with one name the last one holds.
    """
    name = lambda p: F.trim(F.get(p, F.lit(0)))
    named = _pairs(lines, column).withColumn("_names", _once(F.transform("_pairs", name)))
    later = lambda i: F.array_contains(F.slice("_names", i + 2, F.size("_names")), F.get("_names", i))
    last = F.filter("_pairs", lambda p, i: ~later(i))
    parts = F.map_from_entries(F.transform(last, lambda p: F.struct(name(p), F.get(p, F.lit(1)))))
    return named.select(
        "ts",
        F.get("_after", F.lit(0)).alias("type"),
        F.get("_after", F.lit(1)).alias("function"),
        _once(parts).alias("parts"),
    )


# The names of the fields of a timing, misspelling included.
_ITERATION, _PARTITIONS, _DATA, _TIME = "Iteration", "Number of partions", "data", "Training model time"
#: Lines of one range, within which runs are told apart by one task per iteration.
RANGE_LINES = 100_000


def _numbers(part: dict[str, Column]) -> list[Column]:
    """Typed columns of a record from the texts of its fields."""

    def first_number(text: Column) -> Column:
        return F.regexp_extract(text, r"\d+", 0).try_cast("bigint")

    halves = F.split(part[_TIME], r"±|\+-")
    deviation = F.regexp_extract(F.get(halves, F.lit(1)), r"^(.*?) per", 1)
    return [
        F.trim(part[_ITERATION]).alias("Iteration"),
        part[_PARTITIONS].isNotNull().alias("_has_partitions"),
        first_number(part[_PARTITIONS]).alias("partitions"),
        part[_DATA].isNotNull().alias("_has_data"),
        first_number(part[_DATA]).alias("n"),
        part[_TIME].isNotNull().alias("_has_time"),
        to_seconds(F.get(halves, F.lit(0))).alias("mean"),
        to_seconds(deviation).alias("std"),
    ]


def timing_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """The fields of timings as typed columns, straight from the lines, without a map of all pieces."""

    def last(name: str) -> Column:
        own = F.filter("_pairs", lambda p: F.trim(F.get(p, F.lit(0))) == name)
        return F.get(F.try_element_at(own, F.lit(-1)), F.lit(1))

    texts = {name: last(name) for name in (_ITERATION, _PARTITIONS, _DATA, _TIME)}
    columns = {f"_t{i}": text for i, text in enumerate(texts.values())}
    found = _pairs(lines, column).select("ts", "_after", _once(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("_t"))
    part = {name: F.col(f"_t._t{i}") for i, name in enumerate(texts)}
    head = [F.get("_after", F.lit(0)).alias("type"), F.get("_after", F.lit(1)).alias("function")]
    return found.select("ts", *head, *_numbers(part)).filter("Iteration IS NOT NULL AND (_has_partitions OR _has_data OR _has_time)")


def timings(records: DataFrame) -> DataFrame:
    """One row per run and iteration from its partition, data and training-time records.

    ``mean`` and ``std`` are seconds, parted by ``±`` or ``+-``. ``records`` come from
    ``split_lines`` or ``timing_records``, in the order of the log: among records of one
    time the stored order holds. A partition record begins a run of its
    iteration, later records of that iteration belong to it, and of several of one kind the
    last holds. Runs without all three kinds have no row.

    Where no iteration has two records of one kind, one grouped aggregate is all.
    Otherwise runs are numbered by running counts: the log is ordered and cut into ranges of
    ``RANGE_LINES``, counts of whole ranges are carried over to the next, and only the lines
    of one iteration in one range are counted one by one. So an iteration that holds a
    third of all lines is spread over as many tasks as it has ranges.
    """
    if "parts" in records.columns:
        part = {n: F.try_element_at("parts", F.lit(n)) for n in (_ITERATION, _PARTITIONS, _DATA, _TIME)}
        records = records.select("ts", "type", "function", *_numbers(part)).filter("Iteration IS NOT NULL")
    records = cut(records.withColumn("_line", F.monotonically_increasing_id()))
    order = F.struct("ts", "_line")

    def gathered(rows: DataFrame, *keys: str) -> DataFrame:
        kinds = {"partitions": ("ts", "type", "function", "partitions"), "data": ("n",), "time": ("mean", "std")}
        last = [
            F.max(F.when(F.col(f"_has_{k}"), F.struct(order.alias("_at"), F.struct(*columns).alias("v")))).alias(f"_{k}")
            for k, columns in kinds.items()
        ]
        most = F.greatest(*[F.count_if(f"_has_{k}") for k in kinds]).alias("_most")
        return rows.groupBy(*keys).agg(*last, most)

    found = cut(gathered(records, "Iteration"))
    if not found.filter("_most > 1").isEmpty():
        found = gathered(_with_run(records), "Iteration", "_run").filter("_run > 0")
    whole = found.filter("_partitions IS NOT NULL AND _data IS NOT NULL AND _time IS NOT NULL")
    head, tail = [f"_partitions.v.{c}" for c in ("ts", "type", "function")], ["_time.v.mean", "_time.v.std", "_data.v.n"]
    return whole.select(*head, "Iteration", *tail, "_partitions.v.partitions")


def _with_run(records: DataFrame) -> DataFrame:
    """Adds ``_run``: how many partition records of its iteration the log holds up to the record."""
    placed = add_dense_id(records, "_number", ["ts", "_line"]).withColumn("_range", F.floor(F.col("_number") / RANGE_LINES))
    placed = cut(placed)
    begun = F.col("_has_partitions").cast("long")
    each = placed.groupBy(F.col("Iteration").alias("_i"), F.col("_range").alias("_r")).agg(F.sum(begun).alias("_n"))
    before = Window.partitionBy("_i").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_carried", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("Iteration", "_range").orderBy("_number").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("_own", F.sum(begun).over(own))
    same = (F.col("Iteration") == F.col("_i")) & (F.col("_range") == F.col("_r"))
    return counted.join(carried, same).withColumn("_run", F.col("_own") + F.col("_carried"))
