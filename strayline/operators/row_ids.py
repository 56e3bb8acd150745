"""Row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayline.lineage import cut

# Spark's monotonically_increasing_id keeps the row's place in its partition in
# the low 33 bits and the partition number above them.
_PLACE_BITS = 33


def add_row_id(df: DataFrame, name: str = "rowId") -> DataFrame:
    """Unique, increasing, not dense; needs neither shuffle nor sort."""
    return df.withColumn(name, F.monotonically_increasing_id())


def add_dense_id(
    df: DataFrame,
    name: str = "id",
    order_by: str | Column | Sequence[str | Column] | None = None,
) -> DataFrame:
    """0-based row numbers without gaps, in the given order or as stored.

    Rows are numbered inside their partition, then moved up by the rows of the
    partitions before: a table of one row per partition, which is what is joined
    back and all that a single task ever orders. A hash of the row breaks ties of
    the order, so equal keys split over partitions. The numbered rows are written
    out first: both passes must see one layout.
    """
    placed = df
    if order_by is not None:
        keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        placed = df.orderBy(*keys, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    placed = cut(placed.withColumn("_place", F.monotonically_increasing_id())).withColumn(
        "_partition", F.shiftright("_place", _PLACE_BITS)
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_partition")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_partition")
        .withColumn(name, F.col("_start") + place)
        .drop("_partition", "_start", "_place")
    )
