"""Casts, feature vectors and standardisation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.functions.vectors import element_sql, name_sql, number_sql
from strayline.operators.moments import first_width, vector_moments
from strayline.roles import as_names

# The casts a table step may make.
ALLOWED_CASTS = {
    "int": ("string", "float", "double"),
    "double": ("float",),
    "float": ("double",),
    "string": ("double", "int"),
}

# The types a column may be cast to.
CAST_TARGETS = ("string", "int", "float", "double", "boolean")

# Up to this many features the statistics are one wide aggregate; beyond, tasks add
# them up in Arrow batches, as the code of so many would be too long. The rows are the same.
WIDE_AGGREGATE_LIMIT = 16
# The same for plain means, which need less code.
WIDE_MEANS_LIMIT = 128


def cast_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast one column in place, refusing casts outside the allowed list."""
    source = dict(df.dtypes)[column]
    if target not in ALLOWED_CASTS.get(source, ()):
        raise TypeError(f"cannot cast {column} from {source} to {target}")
    return df.withColumn(column, F.col(column).try_cast(target))


class CastColumn(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``cast_column`` as a step of an ML pipeline."""

    castTo = Param(Params._dummy(), "castTo", "target type", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, castTo=None):
        super().__init__()
        self._set(**self._input_kwargs)
        if castTo is not None:
            self.setCastTo(castTo)

    def setCastTo(self, value: str) -> CastColumn:
        if value not in CAST_TARGETS:
            raise TypeError(f"cannot cast to {value}")
        return self._set(castTo=value)

    def getCastTo(self) -> str:
        return self.getOrDefault(self.castTo)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return cast_column(dataset, self.getInputCol(), self.getCastTo())


class DenseVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Any ML vector column as a dense one, as a step of an ML pipeline."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), to_dense(self.getInputCol()))


def to_dense(vector: Column | str) -> Column:
    return array_to_vector(vector_to_array(vector))


def nonzero_entries(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Sparse long form ``(id, position, value)`` of an array column."""
    return df.select(id_col, F.posexplode(vector).alias("position", "value")).filter(
        F.col("value") != 0
    )


def feature_sql(df: DataFrame, features: str | Iterable[str]) -> list[str]:
    """SQL text of each feature as a double, from names or from one array column."""
    names = as_names(features)
    if len(names) == 1 and dict(df.dtypes)[names[0]].startswith("array"):
        return checked_elements_sql(df, names[0])
    return [f"cast({name_sql(c)} AS double)" for c in names]


def checked_elements_sql(df: DataFrame, vector: str) -> list[str]:
    """SQL text of each element; a vector of another length than the first is an error where it is read."""
    width = first_width(df, vector)
    if width is None:
        raise ValueError(f"column {vector!r} holds no vector")
    first, *others = element_sql(vector, width)
    wrong = f"raise_error(concat('vectors of {width} and of ', size({name_sql(vector)}), ' dimensions'))"
    return [f"CASE WHEN size({name_sql(vector)}) <> {width} THEN {wrong} ELSE {first} END", *others]


def _array(terms: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(terms)})")


def assemble(df: DataFrame, features: str | Iterable[str], output: str = "features") -> DataFrame:
    """Add the features as one ARRAY<DOUBLE> column."""
    return df.withColumn(output, _array(feature_sql(df, features)))


@dataclass(frozen=True)
class Scaler:
    """Per-feature statistics of a table, and the scaled features they give."""

    terms: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    rows: int = 0

    def _scaled_sql(self, standardize: bool) -> list[str]:
        if not standardize:
            return list(self.terms)
        return [
            f"({x} - {number_sql(mean)}) / {number_sql(std)}" if std else f"{x} * 0D"
            for x, mean, std in zip(self.terms, self.means, self.stds)
        ]

    def columns(self, standardize: bool = True) -> list[Column]:
        """``(x - mean) / sample deviation``; constant features become 0."""
        return [F.expr(x) for x in self._scaled_sql(standardize)]

    def vector(self, standardize: bool = True) -> Column:
        return _array(self._scaled_sql(standardize))

    def ranges(self, standardize: bool = True) -> list[float]:
        spans = [high - low for low, high in zip(self.lows, self.highs)]
        if not standardize:
            return spans
        return [span / std if std else 0.0 for span, std in zip(spans, self.stds)]


def fit_scaler(df: DataFrame, features: str | Iterable[str]) -> Scaler:
    """One pass over the table; only one row per feature reaches the driver.

    NaN is an unknown value like NULL: statistics are those of the known ones.
    """
    terms = feature_sql(df, features)
    statistics = ("avg", "stddev_samp", "min", "max")
    if len(terms) <= WIDE_AGGREGATE_LIMIT:
        each = [F.expr(f"{s}(nullif({x}, double('nan')))") for x in terms for s in statistics]
        *row, n = df.agg(*each, F.count(F.lit(1))).first()
        found = [row[i * 4 : i * 4 + 4] for i in range(len(terms))]
    else:
        moments = vector_moments(df.select(_array(terms).alias("_v")), "_v", width=len(terms)).collect()
        by_place = {r["position"]: r for r in moments}
        n = max((r["known"] for r in moments), default=0)
        found = [_statistics(by_place.get(i)) for i in range(len(terms))]
    numbers = [tuple(0.0 if v is None else float(v) for v in values) for values in found]
    means, stds, lows, highs = zip(*numbers)
    return Scaler(tuple(terms), means, stds, lows, highs, n)


def _statistics(moments) -> tuple:
    """Mean, sample deviation, lowest and highest value of one feature."""
    if moments is None or not moments["known"]:
        return (None,) * 4
    spread = (moments["deviations"] / (moments["known"] - 1)) ** 0.5 if moments["known"] > 1 else None
    return moments["mean"], spread, moments["low"], moments["high"]


def standardize(
    df: DataFrame,
    features: str | Iterable[str],
    output: str = "scaled_features",
    enabled: bool = True,
) -> DataFrame:
    """Add the scaled features as one ARRAY<DOUBLE> column."""
    if not enabled:
        return assemble(df, features, output)
    return df.withColumn(output, fit_scaler(df, features).vector())


def known_label(df: DataFrame, label: str) -> Column:
    """True where the label is neither NULL nor NaN; never NULL itself."""
    column = F.col(label)
    if dict(df.dtypes)[label] in ("double", "float"):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def split_known(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known label, and the others."""
    known = known_label(df, label)
    return df.filter(known), df.filter(~known)


def select_labels(df: DataFrame, label: str, keep: Iterable | None = None) -> DataFrame:
    """Rows whose label is listed; every row when nothing is listed."""
    wanted = list(keep) if keep is not None else []
    return df.filter(F.col(label).isin(wanted)) if wanted else df


def shift_clusters(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Number clusters from 1 instead of 0."""
    return df.withColumn(cluster, F.col(cluster) + 1)
