"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut

HOT_KEY_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_KEY_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows and into how many parts to split each.

    None when there are none. Counts are combined before the shuffle, and at most
    ``rows / limit`` keys are left. The result is written, so the joins that use it
    are planned on its real size.
    """
    found = cut(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    )
    return None if found.isEmpty() else found


def salted(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None, spread_by: Sequence[str]
) -> DataFrame:
    """Add ``_salt``: a part number for rows of hot keys, 0 for all others."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    part = F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int")
    return (
        df.join(hot, list(keys), "left")
        .withColumn("_salt", F.coalesce(part, F.lit(0)))
        .drop("_parts")
    )


def replicated(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """One copy of each row per part of its key, under ``_salt``."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    return (
        df.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_parts")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    counted: bool = False,
) -> DataFrame:
    """Join on ``keys`` where the left side may be skewed (inner or left joins).

    Rows of a hot left key are spread over parts and only the right rows of such
    keys are copied. Without hot keys this is the plain join. ``hot`` with
    ``counted`` saves counting the same keys again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only the left side may be spread")
    if not counted:
        hot = hot_keys(left, keys)
    if hot is None:
        return left.join(right, list(keys), how)
    return (
        salted(left, keys, hot, spread_by)
        .join(replicated(right, keys, hot), [*keys, "_salt"], how)
        .drop("_salt")
    )
