"""Alignment of two tokenizers' tokens: groups by pointer jumping, links counted over the corpus."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.interpolation import pack_numbers, unpack_numbers
from strayline.llm.tokens import slices, sums_by

#: Texts are aligned in batches of about so many bytes and so many rows at most.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 8192
#: Links that are spelled out at a time.
LINKS = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies.

    Bytes that print stand for themselves, the others for the letters from 256 on.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: How a byte-level vocabulary of this kind parts a text before it merges. Fixed value.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level vocabulary file of ``tokenizers``; the strings of special tokens are plain text.

    Where the file says no more than its vocabulary does, that is where merges come in the
    order of their ids and nothing but the usual parting of texts is asked for, ``tiktoken``
    gives the same ids in a fraction of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.plain = self._plain(json.loads(self.tokenizer.to_str()))

    def _plain(self, file: dict):
        """The same vocabulary as a ``tiktoken`` encoding, if that is all there is to it."""
        from tiktoken import Encoding

        model, parted = file["model"], file["pre_tokenizer"] or {}
        special = {t["id"] for t in file["added_tokens"]}
        ids = {self.bytes[i]: i for i in model["vocab"].values() if i not in special}
        usual = (
            file["normalizer"] is None
            and all(t["special"] for t in file["added_tokens"])
            and (parted.get("type"), parted.get("add_prefix_space"), parted.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        merged = [model["vocab"].get("".join(m)) for m in pairs]
        in_order = usual and None not in merged and merged == sorted(set(merged)) and len(ids) == 256 + len(merged)
        return Encoding("byte level", pat_str=PARTS, mergeable_ranks=ids, special_tokens={}) if in_order else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.plain is not None:
            return [self.plain.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` model, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [self._bytes(i) for i in ids]

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _first_at_or_after(ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many ends lie before each place: the number of the first that does not."""
    passed = np.zeros(int(max(ends.max(initial=0), places.max(initial=0))) + 1, np.int32)
    passed[ends] = 1
    return np.cumsum(passed, dtype=np.int32)[places - 1].astype(np.int64)


def last_of_group(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token of A and of B, the number of the last B token of its group.

    Both cut the same bytes; a token is known by the byte after its last. Every token
    points to the token of the other side that overlaps it farthest to the right,
    which is the one that holds its last byte; a B token that ends where that one
    ends is terminal and points to itself. Pointers then jump to their targets'
    targets, all at once, until none moves: chains halve in each round. A chain never
    passes an offset where both sides end, as no token holds bytes on both sides of it.
    """
    n = len(ends_a)
    to_b, to_a = _first_at_or_after(ends_b, ends_a), _first_at_or_after(ends_a, ends_b)
    itself = n + np.arange(len(ends_b))
    ends_there = ends_a[np.minimum(to_a, max(n - 1, 0))] == ends_b if n else np.ones(len(ends_b), bool)
    target = np.concatenate((n + to_b, np.where(ends_there, itself, to_a)))
    while True:
        jumped = target[target]
        if np.array_equal(jumped, target):
            break
        target = jumped
    return target[:n] - n, target[n:] - n


@dataclass
class Side:
    """Tokens of one tokenizer over all texts of a batch in a row."""

    ids: np.ndarray
    counts: np.ndarray  # tokens per text
    ends: np.ndarray  # byte after each token's last, in all texts

    @classmethod
    def of(cls, encoded: list[list[int]], sizes: np.ndarray) -> Side:
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int64, int(counts.sum()))
        return cls(ids, counts, np.cumsum(sizes[ids]))


def _different(group: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of each group, groups in order, and how often each is there."""
    key, n = np.unique(group * most + ids, return_counts=True)
    return key // most, key % most, n


def _added_up(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of ``n`` of each."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new], np.add.reduceat(n[order], new)


def links_of(group_a, a, n_a, group_b, b, n_b, text_of_group, most_a: int, most_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, pair, links`` of the different id pairs of each text.

    Ids are different within a group and groups are in order, so a group's pairs are
    as many as its different ids allow, however often they recur. They are spelled out
    ``LINKS`` at a time. A text's number and a pair together are far below 2**63.
    """
    of_group = np.bincount(group_b, minlength=len(text_of_group))
    first_b, per_a = (np.cumsum(of_group) - of_group)[group_a], of_group[group_a]
    running = np.concatenate(([0], np.cumsum(per_a)))
    most = most_a * most_b
    keys, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(running, running[at] + LINKS, "right")) - 1)
        some = np.repeat(np.arange(at, to), per_a[at:to])
        other = first_b[some] + np.arange(len(some)) - (running[some] - running[at])
        key, n = _added_up(text_of_group[group_a[some]] * most + a[some] * most_b + b[other], n_a[some] * n_b[other])
        keys.append(key)
        links.append(n)
        at = to
    key, n = np.concatenate(keys), np.concatenate(links)
    if len(keys) > 2:  # a text's pairs may come from several rounds
        key, n = _added_up(key, n)
    return key // most, key % most, n


class Aligner:
    """Two tokenizers and what a batch of texts gives."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))

    @cached_property
    def spelled(self) -> list[str]:
        """Every id with what may follow it: the next of its group, the other side, a group, nothing."""
        return [f"{i}{s}" for i in range(max(len(self.sizes_a), len(self.sizes_b))) for s in (",", "|", ";", "")]

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Which texts have tokens, and those of both sides: their bytes are the text after a space."""
        some = [k for k, t in enumerate(texts) if t]
        given = [texts[k] for k in some]
        kept, left, right = [], [], []
        for k, text, x, y in zip(some, given, self.a.encode(given), self.b.encode(given)) if given else ():
            want = b" " + text.encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == want == b"".join(map(self.b.bytes.__getitem__, y)):
                kept.append(k)
                left.append(x)
                right.append(y)
        return np.array(kept, np.int64), left, right

    def batch(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Columns of a batch of texts; ``pairs`` are the batch's different ones, which ``places`` number."""
        kept, left, right = self.tokens(texts)
        a, b = Side.of(left, self.sizes_a), Side.of(right, self.sizes_b)
        last_a, last_b = last_of_group(a.ends, b.ends)
        is_last = last_b == np.arange(len(last_b))
        terminal, number = np.flatnonzero(is_last), np.cumsum(is_last) - 1
        group_a, group_b = number[last_a], number[last_b]
        text_of_group = np.repeat(np.arange(len(kept)), b.counts)[terminal]
        groups = np.bincount(text_of_group, minlength=len(kept))
        links = np.bincount(group_a, minlength=len(terminal)) * np.bincount(group_b, minlength=len(terminal))
        text, pair, n = links_of(
            *_different(group_a, a.ids, len(self.sizes_a)), *_different(group_b, b.ids, len(self.sizes_b)), text_of_group,
            len(self.sizes_a), len(self.sizes_b),
        )
        pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(text, np.arange(len(kept) + 1))
        out = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "different")}
        for column, values in zip(out, (a.counts, b.counts, groups, sums_by(links, groups), np.diff(cuts))):
            out[column][kept] = values
        out |= {"groups_sha256": [""] * len(texts), "places": [None] * len(texts), "links": [None] * len(texts)}
        for k, listed, i, j in zip(kept, self._listed(a, b, group_a, group_b, text_of_group), cuts, cuts[1:]):
            out["groups_sha256"][k] = sha256(listed.encode()).hexdigest()
            out["places"][k] = pack_numbers(np.diff(place[i:j], prepend=0))
            out["links"][k] = pack_numbers(n[i:j])
        return out | {"pairs": pairs, "held": held}

    def _listed(self, a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, text_of_group: np.ndarray) -> Iterator[str]:
        """Per text its groups: ids of A, ids of B, group after group."""
        side = np.concatenate((group_a * 2, group_b * 2 + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((a.ids, b.ids))[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        follows = np.where(last, 1 + (side & 1), 0)
        ends = np.cumsum(a.counts + b.counts)
        follows[ends - 1] = 3
        codes = (ids * 4 + follows).tolist()
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield "".join(map(self.spelled.__getitem__, codes[start:end]))


_DOCUMENT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "different", "places", "links"]


def _aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text: str) -> DataFrame:
    """One row per document; the first row of a batch also has the batch's pairs and how many documents hold each."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, task = Aligner(path_a, path_b), 0, TaskContext.get().partitionId()
        for table in slices(batches, SLICE_BYTES):
            for at in range(0, table.num_rows, SLICE_ROWS):
                part = table.slice(at, SLICE_ROWS).combine_chunks()
                made = aligner.batch(part.column("text").to_pylist())
                once = lambda x, t: pa.array([x] + [None] * (part.num_rows - 1), t)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").combine_chunks(), pa.array([task << 24 | number] * part.num_rows, pa.int64())]
                    + [pa.array(made[c], t) for c, t in zip(_DOCUMENT, kinds)]
                    + [once(len(made["pairs"]), pa.int64())]
                    + [once(pack_numbers(x), pa.binary()) for x in (np.diff(made["pairs"], prepend=0), made["held"])],
                    ["id", "batch", *_DOCUMENT, "size", "pairs", "held"],
                )
                number += 1

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    schema = f"id {kind}, batch long, {numbers}, groups_sha256 string, different long, places binary, links binary, size long, pairs binary, held binary"
    return narrow.mapInArrow(run, schema)


def _asked(aligned: DataFrame) -> DataFrame:
    """``batch, place, pair, held``: each different pair of each batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, size, pairs, held in zip(*(rows.column(c).to_pylist() for c in ("batch", "size", "pairs", "held"))):
                pair = np.cumsum(unpack_numbers(pairs, size), dtype=np.uint64).view(np.int64)
                arrays = [np.full(size, batch), np.arange(size), pair, unpack_numbers(held, size).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["batch", "place", "pair", "held"])

    some = aligned.filter("size > 0").select("batch", "size", "pairs", "held")
    return some.mapInArrow(run, "batch long, place long, pair long, held long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    ``path_a`` is a byte-level vocabulary, ``path_b`` a sentencepiece model. Offsets
    where tokens of both end cut a text after a space into groups; within a group every
    token of one is linked with every token of the other. The count of an id pair is the
    number of documents that hold it linked. ``n_best`` are the links whose count is the
    highest that their A id has, ``count_sum`` is the sum of all links' counts. NULL and
    empty texts, and texts that the tokens do not spell byte by byte, have no tokens:
    zeros and an empty hash. Whole texts are encoded, however long. Repeated rows are
    documents of their own, an empty table gives an empty one, and other columns are
    ignored whatever their names.

    A batch of texts sends each of its different pairs once; they are summed by pair and
    joined back. No pair has more than one row per batch, so none is hot. What returns
    to a batch is bounded by its size.
    """
    from sentencepiece import SentencePieceProcessor

    kind = dict(docs.dtypes)[id_col]
    most_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = cut(_aligned(docs, path_a, path_b, id_col, text))
    asked = _asked(aligned)
    counts = cut(asked.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.floor(F.col("pair") / most_b)))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    # One row per id of A at most: the size of a vocabulary.
    known = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    told = asked.select("batch", "place", "pair").join(known, "pair").select("batch", "place", "count", "is_best")

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(told.column("place")))
        count, is_best = np.asarray(told.column("count"))[order], np.asarray(told.column("is_best"))[order].astype(np.int64)
        n_best, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        for k, (n, places, links) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("different", "places", "links")))):
            if n:
                place = np.cumsum(unpack_numbers(places, n), dtype=np.uint64).view(np.int64)
                times = unpack_numbers(links, n).view(np.int64)
                n_best[k], total[k] = (times * is_best[place]).sum(), (times * count[place]).sum()
        return rows.select(["id", *_DOCUMENT[:5]]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = aligned.select("id", "batch", *_DOCUMENT)
    out = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, schema)
    return out.select(F.col("id").alias(id_col), *_DOCUMENT[:4], "n_best", "count_sum", "groups_sha256")
