"""Ranked lexical search: one automaton of all items' terms scans the texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.rows import whole_text
from strayline.llm.terms import folded, term_counts
from strayline.llm.tokens import slices

#: A term: no ASCII character but letters and digits; only A-Z are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BEST = 10
#: Share, in hundredths, of a document's length in its saturation.
LENGTH_SHARE = 90
#: Items are searched in blocks of about so many bytes of text, whose automaton and
#: terms every task holds; each block reads the documents once.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
#: Scores that are held at a time, items times documents.
CELLS = 1 << 22
#: The tasks' best rows meet in so many groups per item before they meet in one.
GROUPS = 64


def terms_of(text: str | None) -> list[str]:
    """The different terms of an item."""
    return sorted(set(TERM.findall((text or "").translate(LOWER))))


@dataclass
class Items:
    """Terms of a block of items, and which items each term belongs to."""

    ids: pa.Array
    terms: list[str]
    heads: np.ndarray  # where each term's items begin in ``owners``
    owners: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str | None], kind: pa.DataType) -> Items:
        """Rows that share an id are one item with the terms of all."""
        order = {i: n for n, i in enumerate(dict.fromkeys(ids))}
        held = {(t, order[i]) for i, text in zip(ids, texts) for t in terms_of(text)}
        pairs = sorted(held)
        terms = sorted({t for t, _ in pairs})
        place = {t: n for n, t in enumerate(terms)}
        at = np.fromiter((place[t] for t, _ in pairs), np.int64, len(pairs))
        heads = np.searchsorted(at, np.arange(len(terms) + 1))
        return cls(pa.array(list(order), kind), terms, heads, np.fromiter((o for _, o in pairs), np.int64, len(pairs)))

    def automaton(self):
        """Every term between two blanks: a match cannot begin or end inside a longer term."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            made.add_word(f" {term} ", number)
        made.make_automaton()
        return made


def occurrences(texts: pa.Array, automaton) -> Iterator[tuple[int, list[int], list[int]]]:
    """Per text, how many terms it has, which terms of the automaton, and how often.

    Matches may share a blank, so neighbours are both found.
    """
    data, bounds = folded(texts)
    for k, n in enumerate(term_counts(data, bounds)):
        found: Counter = Counter()
        if n and len(automaton):
            line = f" {data[bounds[k] : bounds[k + 1]].tobytes().decode()} "
            found = Counter(map(itemgetter(1), automaton.iter(line)))
        yield int(n), list(found), list(found.values())


def _scan(docs: DataFrame, items: Items, id_col: str, text: str) -> DataFrame:
    """``id, n, terms, tf`` of every row: its length and the items' terms it holds."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for table in slices(batches, SLICE_BYTES):
            table = table.combine_chunks()
            found = list(occurrences(table.column("text").combine_chunks(), automaton))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], ["id", "n", "terms", "tf"])

    narrow = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>")


def _documents_with(hits: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; tasks send sums, not rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    found = hits.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms, np.int64)
    df[np.asarray(found.column("term"))] = np.asarray(found.column("n"))
    return df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000.0 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _scores(items: Items, weight: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Score of every item for some documents, ``[items, documents]``.

    Sums stay far below 2**53, so adding them as doubles is exact.
    """
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(length, 1)
    doc = np.repeat(np.arange(len(n)), sizes)
    gain = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    shared = items.heads[terms + 1] - items.heads[terms]
    each = np.repeat(np.arange(len(terms)), shared)
    place = np.arange(len(each)) - np.repeat(np.cumsum(shared) - shared, shared) + items.heads[terms][each]
    cell = items.owners[place] * len(n) + doc[each]
    return np.bincount(cell, weights=gain[each], minlength=len(items.ids) * len(n)).astype(np.int64).reshape(-1, len(n))


_ORDER = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]


def _leading(rows: pa.Table) -> pa.Table:
    """The ``BEST`` rows of each item; among equal scores the smallest ids, NULL last."""
    rows = rows.sort_by(_ORDER)
    item = np.asarray(rows.column("item"))
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return rows.filter(pa.array(rank < BEST))


def _ranked(hits: DataFrame, items: Items, item_kind: str) -> DataFrame:
    """``item_id, rank, id, score`` of one block: each task keeps its own best rows."""
    kind = dict(hits.dtypes)["id"]
    totals = hits.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = totals["documents"], totals["length"] or 0
    weight = weights(_documents_with(hits, len(items.terms)), documents)
    shared = hits.sparkSession.sparkContext.broadcast((items, weight))
    step = max(1, CELLS // max(len(items.ids), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best, floor = None, np.ones(len(items.ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column("terms")
                sizes = np.asarray(lists.value_lengths()).astype(np.int64)
                terms, tf = (np.asarray(c.flatten()).astype(np.int64) for c in (lists, part.column("tf")))
                scores = _scores(items, weight, np.asarray(part.column("n")), sizes, terms, tf, documents, length)
                item, doc = np.nonzero(scores >= floor[:, None])
                new = pa.table([pa.array(item), pa.array(scores[item, doc]), part.column("id").take(pa.array(doc))], ["item", "score", "id"])
                best = _leading(new if best is None else pa.concat_tables([best, new]))
                own = np.asarray(best.column("item"))
                full = np.bincount(own, minlength=len(floor)) == BEST
                last = np.searchsorted(own, np.arange(len(floor)), "right") - 1
                floor[full] = np.asarray(best.column("score"))[last[full]]
        if best is not None and best.num_rows:
            best = best.combine_chunks()
            group = pa.array([TaskContext.get().partitionId() % GROUPS] * best.num_rows, pa.int32())
            columns = [items.ids.take(best.column("item").combine_chunks()), *(best.column(c).combine_chunks() for c in ("id", "score"))]
            yield pa.RecordBatch.from_arrays([*columns, group], ["item_id", "id", "score", "group"])

    rows = hits.filter("size(terms) > 0").mapInArrow(run, f"item_id {item_kind}, id {kind}, score long, group int")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for keys in (["item_id", "group"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= BEST)
    return rows.select("item_id", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``BEST`` documents of each item, best first.

    Documents are scanned whole by an automaton of all items' terms; no index of them is
    made. What a scan finds is written once: lengths, and the terms that items ask for.
    Number of documents, their length and how many hold a term are sums over all of
    them. Only documents with a score above 0 are ranked, equal scores by ascending id,
    a NULL id last. Items or documents without terms, NULL or empty ones among them, have
    no rows, as have empty tables; rows of items that share an id are one item, repeated
    documents are ranked each. Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    item_kind = dict(items.dtypes)[item_id]
    asked = items.select(F.col(item_id).alias("item_id"), whole_text(item_text).alias("text")).dropDuplicates()
    size = asked.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = 1 + size // BLOCK_BYTES
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)))
    found = []
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).orderBy("item_id").toArrow()
        made = Items.of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), rows.schema.field("item_id").type)
        if made.terms or not found:
            found.append(_ranked(cut(_scan(docs, made, id_col, text)), made, item_kind))
    out = reduce(DataFrame.union, found)
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score")
