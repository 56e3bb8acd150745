"""Sums over vectors that tasks add up before Spark does: moments of any width in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups a task holds before it hands on what it has.
HELD_GROUPS = 4096
#: Vectors that are looked through for a first known value of each element.
ORIGINS = 16


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; NULL elements are NaN. There must be no NULL vector."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, width))
    lengths = pc.unique(lists.value_lengths())
    if len(lengths) != 1 or lengths[0].as_py() != width:
        raise ValueError(f"vectors of {lengths.to_pylist()} dimensions where {width} are expected")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def total(df: DataFrame, size: int, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``size`` numbers that ``partial`` gives for a batch of them.

    A task adds up its batches and sends one row, which Spark sums place by place;
    ``size`` numbers reach the driver, whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                sums += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    placed = df.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    found = placed.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[np.asarray(found.column("place"))] = np.asarray(found.column("value"))
    return out


def first_width(df: DataFrame, vector: str) -> int | None:
    """Dimensions of some vector of the column; None if there is none."""
    row = df.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return None if row is None else row[0]


def vector_moments(df: DataFrame, vector: str, by: str | None = None, width: int | None = None) -> DataFrame:
    """``[by,] position, known, mean, deviations, low, high`` of each element, in one pass.

    ``known`` counts the elements that are neither NULL nor NaN, ``deviations`` is the sum
    of their squared distances from their mean. Tasks hold one buffer per group, of any
    width; what they send is summed by group and position. Sums are taken about the first
    known values, which keeps them exact where values are large and alike.
    """
    column = F.col(vector).cast("array<double>").alias("v")
    rows = df.select(column, *([F.col(by).alias("g")] if by else [])).filter("v IS NOT NULL")
    seen = [r["v"] for r in rows.select("v").limit(ORIGINS).collect()]
    width = width or (len(seen[0]) if seen else 0)
    about = np.zeros(width)
    for vector_seen in reversed([v for v in seen if len(v) == width]):
        values = np.array([np.nan if x is None else x for x in vector_seen], float)
        about = np.where(np.isfinite(values), values, about)
    kind = dict(rows.dtypes).get("g")
    names = ["known", "sums", "squares", "low", "high"]

    def rows_of(held: dict, group_type: pa.DataType | None) -> pa.RecordBatch:
        arrays = [pa.array([b[k].tolist() for b in held.values()], pa.list_(pa.float64())) for k in range(5)]
        keys = [pa.array(list(held), group_type)] if kind else []
        return pa.RecordBatch.from_arrays([*keys, *arrays], [*(["g"] if kind else []), *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        group_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("v"), width)
            if kind:
                group_type = batch.schema.field("g").type
                coded = batch.column("g").dictionary_encode(null_encoding="encode")
                codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            else:
                codes, keys = np.zeros(len(x), np.int64), [None]
            order = np.argsort(codes, kind="stable")
            first = np.searchsorted(codes[order], np.arange(len(keys)))
            x = x[order]
            there = ~np.isnan(x)
            off = np.where(there, x - about, 0.0)
            add = lambda values: np.add.reduceat(values, first)
            found = [
                add(there.astype(float)), add(off), add(off * off),
                np.minimum.reduceat(np.where(there, x, np.inf), first), np.maximum.reduceat(np.where(there, x, -np.inf), first),
            ]
            for k, key in enumerate(keys):
                own = [f[k] for f in found]
                if key in held:
                    b = held[key]
                    own = [b[0] + own[0], b[1] + own[1], b[2] + own[2], np.minimum(b[3], own[3]), np.maximum(b[4], own[4])]
                held[key] = own
            if len(held) > HELD_GROUPS:
                yield rows_of(held, group_type)
                held = {}
        if held:
            yield rows_of(held, group_type)

    schema = (f"g {kind}, " if kind else "") + ", ".join(f"{n} array<double>" for n in names)
    keys = ["g", "position"] if kind else ["position"]
    placed = rows.mapInArrow(run, schema).select(*keys[:-1], F.posexplode(F.arrays_zip(*names)).alias("position", "e"))
    summed = placed.groupBy(*keys).agg(
        *[F.sum(f"e.{n}").alias(n) for n in names[:3]], F.min("e.low").alias("low"), F.max("e.high").alias("high")
    )
    shift = F.get(F.array(*[F.lit(float(a)) for a in about]) if width else F.array().cast("array<double>"), F.col("position"))
    some = F.when(F.col("known") > 0, F.col("known"))
    return summed.select(
        *([F.col("g").alias(by)] if by else []),
        "position",
        F.col("known").cast("bigint").alias("known"),
        (shift + F.col("sums") / some).alias("mean"),
        F.greatest(F.col("squares") - F.col("sums") * F.col("sums") / some, F.lit(0.0)).alias("deviations"),
        F.when(F.col("known") > 0, F.col("low")).alias("low"),
        F.when(F.col("known") > 0, F.col("high")).alias("high"),
    )
