"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.llm.rows import whole_text
from strayline.operators.row_ids import add_dense_id

ROUNDS = 6
LONGEST_WALK = 64


def _sides(n: int) -> tuple[int, int]:
    """The smallest near-square ``a * b >= n``; it exceeds n by less than 2 sqrt(n) + 1."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of an unbalanced Feistel network: a permutation of [0, a * b)."""
    right = F.pmod(x, F.lit(b))
    left = F.call_function("div", x, F.lit(b))
    for step in range(ROUNDS):
        key = F.lit(seed * ROUNDS + step)
        if step % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(key, right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(key, left), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permuted(df: DataFrame, number: str, n: int, name: str, seed: int = 0) -> DataFrame:
    """Add ``name``: the place of row ``number`` in a pseudo-random order of [0, n).

    The network permutes the domain ``a * b >= n``; a value that lands at n or
    beyond is permuted again until it is below n (cycle walking), which makes the
    whole a permutation of [0, n). A walk cannot be longer than the ``a * b - n``
    values beyond plus one. Above ``LONGEST_WALK`` steps, whose chance is below
    1e-40 for any n that has such walks, the job fails instead of placing a row
    wrongly.
    """
    a, b = _sides(n)
    walk = min(a * b - n + 1, LONGEST_WALK)
    first = df.withColumn(name, _feistel(F.col(number).cast("long"), a, b, seed))
    if a * b == n:
        return first
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walk)),
        F.col(name),
        lambda at, _: F.when(at < n, at).otherwise(_feistel(at, a, b, seed)),
    )
    done = first.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked))
    return done.withColumn(
        name, F.when(F.col(name) < n, F.col(name)).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    )


def shard_rows(
    df: DataFrame, order_by: list[str | Column], shards: int, seed: int = 0
) -> DataFrame:
    """Add ``shard`` and ``slot``: a reproducible shuffle of all rows into shards.

    Rows are numbered from 0 in the given order (ties by a hash of the row), the
    number is permuted, and the place p gives ``shard = p mod shards`` and
    ``slot = p div shards``. Shard sizes differ by at most one and slots have no
    gaps. Anybody who knows the row number, n and the seed can compute shard and
    slot without the table. NULL keys are ordered first, rows that agree in
    everything get different places, an empty table stays empty. Input columns
    named ``shard``, ``slot``, ``_number`` or ``_placed`` are replaced.
    """
    own = df.drop("shard", "slot", "_number", "_placed")
    numbered = add_dense_id(own, "_number", order_by)
    n = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    placed = permuted(numbered, "_number", n, "_placed", seed)
    return placed.select(
        *[F.col(f"`{c}`") for c in own.columns],
        F.pmod("_placed", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_placed div {shards}").cast("long").alias("slot"),
    )


def shard_documents(
    docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` per document.

    Only the id, the size in UTF-8 bytes plus one, and the checksum of the text
    are sorted and moved; the text is read once. A NULL text has no bytes. The
    law is ``rows``: counts differ by at most one, so adding a shard moves rows
    between all shards and ``grown_shard`` is NULL. Equal texts and repeated rows are
    rows like any others, NULL ids come first in the order. An empty table gives an empty
    one, texts have any length, and other columns are ignored whatever their names.
    """
    whole = whole_text(text)
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, [F.col(id_col).asc_nulls_first()], shards, seed).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
