"""Size and counters of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_size(df: DataFrame) -> DataFrame:
    """Rows and megabytes of the table written as JSON text."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)) / 1e6).alias("size_mb"),
    )


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows, and rows where each named condition holds, in one pass.

    An ``Observation`` would count during another job, but once a session has
    used one, models that hold on to the session no longer reach the executors.
    """
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
    )
