"""Generated tables, made on the executors from ``spark.range``."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayline.functions.text import hash_unit
from strayline.operators.row_ids import add_dense_id


def _segment(counts: Sequence[int], row: Column) -> Column:
    """Which of the consecutive segments a row number falls into."""
    chosen, end = F.lit(len(counts) - 1), sum(counts)
    for i in range(len(counts) - 1, 0, -1):
        end -= counts[i]
        chosen = F.when(row < end, F.lit(i - 1)).otherwise(chosen)
    return chosen


def _normals(key: str, n: int, seed: int) -> Column:
    """``n`` normal numbers hashed from the key (Box-Muller), as an array.

    One expression for all of them: the code of a plan does not grow with ``n``.
    """

    def normal(j: Column) -> Column:
        radius = F.sqrt(-2 * F.log(1 - hash_unit(key, seed=2 * (j + seed))))
        return radius * F.cos(2 * math.pi * hash_unit(key, seed=2 * (j + seed) + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), normal)


def gaussian_clusters(
    spark: SparkSession,
    counts: Sequence[int],
    means: Sequence[Sequence[float]],
    stds: Sequence[Sequence[float]] | None = None,
    features: int | Sequence[str] = 10,
    seed: int = 0,
) -> DataFrame:
    """Normally distributed clusters with columns for the features, ``id`` and ``k``."""
    if len(means) != len(counts):
        raise ValueError("need one mean per cluster")
    names = list(string.ascii_lowercase[:features]) if isinstance(features, int) else list(features)
    stds = stds or [[1.0] * len(names) for _ in counts]
    rows = spark.range(sum(counts)).withColumn("k", _segment(counts, F.col("id")))

    def parameter(values: Sequence[Sequence[float]]) -> Column:
        table = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in values])
        return F.get(table, F.col("k"))

    # Worked out once per row: what reads the values cannot repeat their expression.
    drawn = F.zip_with(parameter(stds), _normals("id", len(names), seed), lambda s, z: s * z)
    values = F.explode(F.array(F.zip_with(parameter(means), drawn, lambda m, x: m + x)))
    rows = rows.select("id", "k", values.alias("_values"))
    columns = [F.get("_values", F.lit(j)).alias(name) for j, name in enumerate(names)]
    return rows.select(*columns, "id", F.col("k").cast("bigint").alias("k"))


def _drawn(df: DataFrame, group: str, counts: Sequence[int], keep: int, seed: int) -> DataFrame:
    """Add ``_drawn``: true for exactly ``keep`` random rows of each group.

    Rows are ranked by (group, hash) in one distributed sort. As the group sizes
    are known, so is the rank at which each group starts.
    """
    starts = [sum(counts[:i]) for i in range(len(counts))]
    first = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col(group).cast("int"))
    ranked = add_dense_id(
        df.withColumn("_hash", hash_unit("id", seed=seed)), "_rank", [group, "_hash"]
    )
    return ranked.withColumn("_drawn", F.col("_rank") - first < keep).drop("_rank", "_hash")


def double_helix(
    spark: SparkSession,
    points_per_helix: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    missing: float = 0.01,
    seed: int = 0,
) -> DataFrame:
    """Two helices ``x, y, z, label, unknown_label, id`` over one draw of angles.

    ``missing`` is the share (or, from 1 on, the number) of points per helix that
    keep their label in ``unknown_label``; the others are NaN there.
    """
    keep = math.ceil(points_per_helix * missing) if missing < 1 else int(missing)
    angle = hash_unit(F.pmod("id", F.lit(points_per_helix)), seed=seed) * F.lit(2 * 3.1415)
    points = spark.range(2 * points_per_helix).select(
        "id",
        F.when(F.col("id") < points_per_helix, 0.0).otherwise(1.0).alias("label"),
        angle.alias("_angle"),
    )
    side = F.when(F.col("label") == 0, F.lit(float(alpha))).otherwise(F.lit(-float(alpha)))
    counts = [points_per_helix, points_per_helix]
    return _drawn(points, "label", counts, keep, seed + 1).select(
        (side * F.sin("_angle")).alias("x"),
        (side * F.cos("_angle")).alias("y"),
        (F.lit(float(beta)) * F.col("_angle")).alias("z"),
        "label",
        F.when(F.col("_drawn"), F.col("label")).otherwise(F.lit(float("nan"))).alias("unknown_label"),
        "id",
    )


def springs(
    spark: SparkSession,
    a: float,
    ranges: Sequence[tuple[float, float, int]],
    draws: int = 1,
    seed: int = 0,
) -> DataFrame:
    """Springs ``id, label, vector``, one per ``(start, stop, points)`` of z.

    ``draws`` points of each spring keep its number as label, the others are NaN.
    """
    counts = [n for _, _, n in ranges]
    starts = [sum(counts[:i]) for i in range(len(counts))]
    rows = spark.range(sum(counts)).withColumn("_spring", _segment(counts, F.col("id")))

    def of_spring(values: Sequence[float], kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_spring"))

    place = F.col("id") - of_spring(starts, "bigint")
    steps = [(stop - start) / (n - 1) if n > 1 else 0.0 for start, stop, n in ranges]
    z = of_spring([float(r[0]) for r in ranges], "double") + place * of_spring(steps, "double")
    curve = F.array(F.lit(float(a)) * F.sin("_z"), F.lit(float(a)) * F.cos("_z"), F.col("_z"))
    return _drawn(rows.withColumn("_z", z), "_spring", counts, draws, seed).select(
        "id",
        F.when(F.col("_drawn"), F.col("_spring").cast("double"))
        .otherwise(F.lit(float("nan")))
        .alias("label"),
        curve.alias("vector"),
    )
