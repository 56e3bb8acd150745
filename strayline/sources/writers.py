"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The key each job's rows are delivered under.
JOB_KEYS = {"cleaning": "cluster", "classification": "classification", "semisupervised": "semisuper"}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, mode="overwrite", header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def as_json_rows(df: DataFrame, job: str) -> DataFrame:
    """Each row as JSON text, with the key of its job."""
    return df.select(F.lit(JOB_KEYS[job]).alias("job"), F.to_json(F.struct("*")).alias("row"))


def write_json_result(df: DataFrame, path: str, job: str) -> None:
    """Rows as JSON files in a folder ``job=<key>``, written by the executors."""
    df.withColumn("job", F.lit(JOB_KEYS[job])).write.mode("overwrite").partitionBy("job").json(path)
