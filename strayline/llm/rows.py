"""Helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a word everywhere here: a run without the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text: str) -> Column:
    """The text, a NULL one as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key(id_col: str, text: str) -> list[Column]:
    """What tells rows apart by content: the id and the SHA-256 of the text."""
    return [F.col(id_col).alias("_id"), F.sha2(whole_text(text), 256).alias("_sha")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text: str, repeated: bool) -> DataFrame:
    """The rows of ``docs`` whose ``_id, _sha`` is in ``kept``, with all their columns.

    The row travels as one struct, so no column of it can clash. With
    ``repeated``, rows that agree in id and text become one; which of their other
    columns stay is then arbitrary. They are combined before the shuffle.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(id_col, text))
    if repeated:
        rows = rows.dropDuplicates(["_id", "_sha"])
    same = rows["_id"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"])
    return rows.join(kept, same, "left_semi").select("_row.*")
