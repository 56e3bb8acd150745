"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.functions.text import hash_unit
from strayline.lineage import cut
from strayline.llm.rows import WORD, whole_text
from strayline.operators.row_ids import add_dense_id

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 3


def words_in(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_rates(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``_source, source_size, target, rate`` per source, from ``_source, size`` rows.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share
    all words. A target stops at ``most`` times its source's size and the excess
    is shared again by weight. Whether a source is stopped depends on one number
    only, the words per unit of weight, which rises until no more sources are
    stopped; each round is one aggregate over the sources that brings two sums
    to the driver. A source without words has target and rate 0.
    """
    sums = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int")
    )
    sources = cut(
        add_dense_id(sums, "_turn", [F.col("_source").asc_nulls_last()]).select(
            "_source", "source_size", turn.alias("_weight")
        )
    )
    most_words = F.col("source_size") * F.lit(most)

    def shared(stopped: Column) -> tuple[int, int, int]:
        row = sources.agg(
            F.sum(F.when(stopped, 0).otherwise(F.col("_weight"))).alias("weight"),
            F.sum(F.when(stopped, most_words).otherwise(0)).alias("taken"),
            F.count(F.when(stopped, 1)).alias("stopped"),
        ).first()
        return row["weight"] or 0, row["taken"] or 0, row["stopped"]

    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    weight, taken, before = shared(F.lit(False))
    level = total / weight if weight else 0.0
    while True:
        stopped = most_words <= F.lit(level) * F.col("_weight")
        weight, taken, now = shared(stopped)
        if now == before or not weight:
            break
        level, before = (total - taken) / weight, now
    target = F.when(stopped, most_words.cast("double")).otherwise(F.lit(level) * F.col("_weight"))
    return sources.select(
        "_source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(rate: Column, id_col: str, seed: int = SEED) -> Column:
    """floor(rate) and one more where a number hashed from the id is below the fraction."""
    whole = F.floor(rate).cast("int")
    return whole + (hash_unit(F.col(id_col), seed=seed) < rate - whole).cast("int")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``id, size, source_size, target, taken`` per document.

    ``taken`` counts the words the mix takes from it, repeats included. The text
    is read once, for its words. A NULL text has no words, a NULL source is a
    source of its own, rows that share an id share its draw. The table of
    sources is joined by whatever its written size allows; where it is too big to
    broadcast, adaptive execution splits the hot source. Repeated rows are taken each, an
    empty table gives an empty one, texts are read whole however long, and other columns
    are ignored whatever their names.
    """
    narrow = cut(docs.select(F.col(id_col), F.col(source).alias("_source"), words_in(text).alias("size")))
    rates = source_rates(narrow, weights, most).withColumnRenamed("_source", "_own")
    return narrow.join(rates, F.col("_source").eqNullSafe(F.col("_own")), "left").select(
        id_col,
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("rate"), id_col, seed)).alias("taken"),
    )


def emit_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Documents of a source with no target are not emitted. The columns are those
    of ``docs``, whatever they are called. NULL texts have no words, a NULL source is a
    source of its own, repeated rows are drawn alike, an empty table stays empty.
    """
    sizes = docs.select(F.col(source).alias("_source"), words_in(text).alias("size"))
    rates = source_rates(sizes, weights, most).select(F.col("_source").alias("_own"), "rate")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_source")
    )
    many = copies(F.col("rate"), f"_row.{id_col}", seed)
    return (
        rows.join(rates, F.col("_source").eqNullSafe(F.col("_own")))
        .select("_row", many.alias("_copies"))
        .filter("_copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )
