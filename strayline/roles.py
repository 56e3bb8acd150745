"""Which columns of a table are ids, labels and features."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_names(names: str | Iterable[str] | None) -> tuple[str, ...]:
    """One name, many names or none, as a tuple of names."""
    if names is None:
        return ()
    if isinstance(names, str):
        return (names,)
    return tuple(names)


@dataclass(frozen=True)
class Roles:
    id: tuple[str, ...]
    labels: tuple[str, ...]
    features: tuple[str, ...]

    @classmethod
    def of(cls, id="id", labels=None, features=None) -> Roles:
        return cls(as_names(id), as_names(labels), as_names(features))

    @classmethod
    def from_columns(cls, df: DataFrame, id="id", labels=None) -> Roles:
        """Every column that is neither id nor label is a feature."""
        taken = set(as_names(id)) | set(as_names(labels))
        return cls(as_names(id), as_names(labels), tuple(c for c in df.columns if c not in taken))

    @property
    def columns(self) -> list[str]:
        return [*self.id, *self.labels, *self.features]

    def schema(self) -> T.StructType:
        """Declared read schema: integer ids, text labels, double features."""
        fields = [T.StructField(c, T.IntegerType(), False) for c in self.id]
        fields += [T.StructField(c, T.StringType(), False) for c in self.labels]
        fields += [T.StructField(c, T.DoubleType(), False) for c in self.features]
        return T.StructType(fields)

    def project(self, df: DataFrame) -> DataFrame:
        """Ids as text, labels as double, text features as float; bad text is NULL."""
        types = dict(df.dtypes)
        ids = [F.col(c).cast("string").alias(c) for c in self.id]
        labels = [F.col(c).try_cast("double").alias(c) for c in self.labels]
        features = [
            F.col(c).try_cast("float").alias(c) if types[c] == "string" else F.col(c)
            for c in self.features
        ]
        return df.select(*ids, *labels, *features)
