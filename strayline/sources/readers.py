"""Readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strayline.roles import Roles

# Reader format by file ending.
FORMATS = {"txt": "text", "csv": "csv", "parquet": "parquet", "json": "json", "jdbc": "jdbc"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_with_missing(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    null_value: str = "nan",
    nan_value: str = "NaN",
    corrupt_column: str | None = None,
) -> DataFrame:
    """Permissive CSV in which ``nan`` stands for a missing value."""
    reader = spark.read.options(
        header=True, mode="PERMISSIVE", nullValue=null_value, nanValue=nan_value
    )
    if corrupt_column is not None:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        if schema is not None and corrupt_column not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_roles(spark: SparkSession, path: str, roles: Roles) -> DataFrame:
    """CSV with a header, read with the schema the roles declare."""
    return read_csv(spark, path, roles.schema())


def extension_of(path: str) -> str:
    found = re.search(r"\.\w+$", path)
    if found is None:
        raise ValueError(f"no file ending in {path!r}")
    return found.group()


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file ending. Without options: header and UTF-8. JSON takes none."""
    fmt = FORMATS[extension_of(path)[1:].lower()]
    if fmt == "json":
        return spark.read.json(path)
    return spark.read.format(fmt).options(**(options or {"header": True, "encoding": "utf-8"})).load(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def pixel_schema(n_pixels: int = 784, label: bool = True) -> T.StructType:
    fields = [T.StructField("label", T.IntegerType())] if label else []
    fields += [T.StructField(f"pixel{i}", T.IntegerType()) for i in range(n_pixels)]
    return T.StructType(fields)


def read_pixels(
    spark: SparkSession, path: str, n_samples: int | None = None, n_pixels: int = 784
) -> tuple[DataFrame, DataFrame]:
    """``train.csv`` (with labels) and ``test.csv`` (without) of a folder."""
    train = read_csv(spark, f"{path}/train.csv", pixel_schema(n_pixels))
    test = read_csv(spark, f"{path}/test.csv", pixel_schema(n_pixels, label=False))
    if n_samples is not None:
        train, test = train.limit(n_samples), test.limit(n_samples)
    return train, test
