"""Exact copies by deterministic naming of fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.rows import keep_rows, whole_text
from strayline.operators.row_ids import add_dense_id
from strayline.operators.skew import salted_join

BLOCK_CHARACTERS = 4096
#: A group of equal texts with more rows is joined in parts of about so many.
HOT_GROUP = 100_000


def _blocks(text: str) -> Column:
    """The text in blocks of ``BLOCK_CHARACTERS``; the empty text has one, empty.

    One sweep cuts them all: a text is not read again for each of its blocks, so the
    time is in proportion to its length.
    """
    cut_up = F.regexp_extract_all(whole_text(text), F.lit(f"(?s).{{1,{BLOCK_CHARACTERS}}}"), F.lit(0))
    return F.when(whole_text(text) == "", F.array(F.lit(""))).otherwise(cut_up)


def _prints(block: Column, seed: int) -> list[Column]:
    """Two independent 64-bit hashes: the key by which blocks are sorted."""
    return [F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block).alias("b")]


def _block_keys(docs: DataFrame, text: str) -> tuple[int, DataFrame]:
    """A seed for which different blocks have different sort keys, and all keys.

    Copies of a block are combined before the shuffle. That no two blocks share a
    key is counted over the blocks themselves; if two did, the next seed is tried.
    """
    for seed in range(1, 100):
        different = docs.select(F.explode(_blocks(text)).alias("block")).distinct()
        keys = cut(different.select(*_prints(F.col("block"), seed)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
        if (keys.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            return seed, keys.select("a", "b")
    raise RuntimeError("no seed separates the blocks")


def identities(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, <id>, _sha, _level, _name``: equal texts, and only those, share level and name.

    Different blocks are sorted and numbered. Then adjacent names of a document
    are paired, the different pairs are sorted and numbered, and so on until every
    document has one name, after as many levels as its blocks have binary digits.
    A name stands for one sequence of bytes by construction: nothing is left to
    the chance of a hash. Copies of a pair are combined before each shuffle.
    """
    seed, keys = _block_keys(docs, text)
    block = lambda b: F.struct(*_prints(b, seed))
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col),
            F.sha2(whole_text(text), 256).alias("_sha"),
            F.transform(_blocks(text), block).alias("_blocks"),
        )
    )
    names = add_dense_id(keys, "name", ["a", "b"])
    open_ = (
        rows.select("_row", F.size("_blocks").alias("left"), F.posexplode("_blocks").alias("place", "key"))
        .select("_row", "left", "place", "key.a", "key.b")
        .join(names, ["a", "b"])
        .select("_row", "left", "place", "name")
    )
    finished, level = [], 0
    while True:
        open_ = cut(open_)
        finished.append(open_.filter("left = 1").select("_row", F.lit(level).alias("_level"), F.col("name").alias("_name")))
        more = open_.filter("left > 1")
        if more.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("place") % 2 == odd, F.col("name")))
        pairs = more.groupBy("_row", F.floor(F.col("place") / 2).cast("int").alias("at"), "left").agg(
            side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")
        )
        pairs = cut(pairs.select("_row", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("at").alias("place"), "a", "b"))
        names = add_dense_id(pairs.select("a", "b").distinct(), "name", ["a", "b"])
        open_ = pairs.join(names, ["a", "b"]).select("_row", "left", "place", "name")
        level += 1
    named = finished[0]
    for part in finished[1:]:
        named = named.unionByName(part)
    return rows.drop("_blocks").join(named, "_row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with the largest id stays; NULL counts as the empty
    text, a NULL id as the smallest. Of rows that agree in both, one stays. Ids
    and counts of a group are combined before the shuffle, and the rows of a very
    large group are joined with them in parts. An empty table gives an empty one, a
    text of any length is read once per pass, and other columns are ignored whatever
    their names.
    """
    named = cut(identities(docs, id_col, text))
    best = F.max(F.struct(F.col(id_col).alias("id"), F.col("_row").alias("row")))
    keys = ["_level", "_name"]
    groups = cut(named.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size")))
    hot = groups.filter(F.col("group_size") > HOT_GROUP).select(*keys, F.ceil(F.col("group_size") / HOT_GROUP).cast("int").alias("_parts"))
    return salted_join(named, groups, keys, ["_row"], hot=None if hot.isEmpty() else hot, counted=True).select(
        id_col,
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are judged as ``exact_groups`` does: NULL texts are empty ones, of rows that
    agree in id and text one stays, an empty table stays empty, and a column may have
    any name.
    """
    groups = cut(exact_groups(docs, id_col, text))
    kept = groups.filter("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    again = groups.groupBy(id_col, "text_sha256").count().filter("count > 1")
    return keep_rows(docs, kept, id_col, text, repeated=not again.isEmpty())
