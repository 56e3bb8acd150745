"""Expressions on ARRAY<DOUBLE> vectors.

Where the number of dimensions is known while the plan is built, distances are
written out term by term, so that they stay inside whole-stage codegen; the
``zip_with`` form serves vectors of unknown length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_width(df: DataFrame, vector: str) -> int | None:
    """Dimensions of the vectors, None without any; rows that do not agree are an error."""
    size = F.when(F.col(vector).isNotNull(), F.size(vector))
    least, most = df.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"column {vector!r} holds vectors of {least} to {most} dimensions")
    return most


def width_of(df: DataFrame, vector: str) -> int:
    """Dimensions of the vectors; a column without one is an error, too."""
    width = known_width(df, vector)
    if width is None:
        raise ValueError(f"column {vector!r} holds no vector")
    return width


def name_sql(column: str) -> str:
    """A column path as SQL text, each part quoted."""
    return ".".join(f"`{part}`" for part in column.split("."))


def element_sql(vector: str, width: int) -> list[str]:
    """SQL text of each element as a double."""
    return [f"cast(get({name_sql(vector)}, {i}) AS double)" for i in range(width)]


def number_sql(value: float) -> str:
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


def squared_distance(a: str, b: str, width: int | None = None) -> Column:
    if width is not None:
        pairs = zip(element_sql(a, width), element_sql(b, width))
        return F.expr(" + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in pairs))
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def euclidean_distance(a: str, b: str, width: int | None = None) -> Column:
    return F.sqrt(squared_distance(a, b, width))


def percentage_distance(distance: Column | str, max_distance: Column) -> Column:
    column = F.col(distance) if isinstance(distance, str) else distance
    return (max_distance - column) / F.lit(100.0)


def scale_by(scores: Column | str, priors: Sequence[float]) -> Column:
    """Element-wise product of a score vector and fixed priors."""
    return F.zip_with(scores, F.array(*[F.lit(float(p)) for p in priors]), lambda s, p: s * p)


def argmax(scores: Column | str) -> Column:
    """0-based index of the largest score, the lowest one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def one_hot(label: Column, k: int, unknown: float = 0.5) -> Column:
    """Score row of a label index: 1.0 at the index, or ``unknown`` everywhere."""
    return F.array(
        *[
            F.when(label.isNull(), F.lit(float(unknown)))
            .when(label == F.lit(c), F.lit(1.0))
            .otherwise(F.lit(0.0))
            for c in range(k)
        ]
    )
