"""Expressions on paths and row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_extension(path: Column | str) -> Column:
    """The closing ``.word`` of a path, empty when there is none."""
    return F.regexp_extract(path, r"\.\w+$", 0)


def hash_unit(*columns: Column | str, seed: int | Column = 0) -> Column:
    """A number in [0, 1) fixed by the columns and the seed.

    Built on MD5, so that any SQL engine reproduces it; NULL counts as the empty
    text. Unlike ``rand`` it gives a row the same number in every run, on every
    partitioning and after every lost executor.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in named]
    digest = F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
