"""Order-preserving packing of documents into training sequences."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.llm.tokens import located, slices

CAPACITY = 4096
END_ID = 2
#: What a cut costs, in padded tokens: at a sentence's end, and elsewhere.
SENTENCE_CUT, WORD_CUT = 8.0, 96.0
#: Without a sentence's end for so many tokens, a document may be cut every so often.
LONGEST_UNCUT = 128
CHUNK_BYTES = 4 << 20
WORDS_KEPT = 3_000_000
_SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")
_CLOSING = ".,!?;:"


class Encoder:
    """Token ids of whole texts, with each different word tokenized once.

    The tokenizer drops white space and treats what stands between on its own, so
    the ids of a text are the ids of its words in a row. A word of letters and
    closing marks is cut before the marks, as the tokenizer does. Words are
    remembered by a 64-bit hash, ``WORDS_KEPT`` of them at most. A tokenizer whose
    file does not say that it works like this is given whole texts.
    """

    def __init__(self, path: str, by_words: bool | None = None):
        """``by_words`` spares looking through the file again where that is known."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_words = _parts_at_letters(json.loads(self.tokenizer.to_str())) if by_words is None else by_words
        self.forget()

    @cached_property
    def marks(self) -> np.ndarray:
        """Which ids end with a sentence's mark."""
        out = np.zeros(len(self.closes), bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if t.removesuffix("</w>").endswith(_SENTENCE_ENDS)]] = True
        return out

    def forget(self) -> None:
        self.keys, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.size, self.stop = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def tokenized(self, parts: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each part has; parts of letters are one run to the tokenizer."""
        flat, sizes = [], []
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            if letters:
                ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
                last = np.flatnonzero(self.closes[ids])
                if len(last) == len(some):
                    flat.append(ids)
                    sizes.append(np.diff(last, prepend=-1))
                    continue
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((i for own in ids for i in own), np.uint32, int(sizes[-1].sum())))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Remember new words, given with their sorted hashes."""
        stems: dict[str, int] = {}
        tails: dict[str, int] = {"": 0}
        whole: list[str] = []
        stem, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            core = word.rstrip(_CLOSING)
            low = core.lower()
            if low.isalpha() and "\u03a3" not in core:
                stem[i] = stems.setdefault(low, len(stems))
                tail[i] = tails.setdefault(word[len(core) :], len(tails))
            else:
                whole.append(word)
                stem[i] = -len(whole)
        ids, sizes = self.tokenized(list(stems), True)
        odd_ids, odd_sizes = self.tokenized(whole, False)
        end_ids, end_sizes = self.tokenized(list(tails), False)
        stem[stem < 0] = len(stems) - 1 - stem[stem < 0]
        ids, sizes = np.concatenate((ids, odd_ids)), np.concatenate((sizes, odd_sizes))
        first, end_first = np.cumsum(sizes) - sizes, np.cumsum(end_sizes) - end_sizes
        # Each word is its stem's ids, then its tail's.
        lengths = np.stack((sizes[stem], end_sizes[tail]), axis=1).ravel()
        begins = np.stack((first[stem], end_first[tail] + len(ids)), axis=1).ravel()
        both = np.concatenate((ids, end_ids))
        new = both[_ranges(begins, lengths)]
        size = lengths.reshape(-1, 2).sum(axis=1)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, np.cumsum(size) - size + len(self.pool))
        self.size = np.insert(self.size, at, size)
        self.stop = np.insert(self.stop, at, [w.endswith(_SENTENCE_ENDS) for w in words])
        self.pool = np.concatenate((self.pool, new))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with ``END_ID`` after each text, ids per text, and where sentences end."""
        if not self.by_words:
            return self.encode_whole(texts)
        found = located(texts)
        keys, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_KEPT:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            data = found.data.tobytes()
            spans = zip(found.starts[first[new]].tolist(), found.ends[first[new]].tolist())
            self.learn(keys[new], [data[a:b].decode("utf-8") for a, b in spans])
            at = np.searchsorted(self.keys, keys)
        sizes = self.size[at][back].astype(np.int64)
        ids = self.pool[_ranges(self.start[at][back], sizes)]
        word_ends = np.concatenate(([0], np.cumsum(sizes)))
        last_word = np.cumsum(found.counts)
        text_ends = word_ends[last_word]
        counts = np.diff(text_ends, prepend=0) + 1
        text_of = np.repeat(np.arange(len(counts)), found.counts)
        stops = word_ends[1:][self.stop[at][back]]
        of = text_of[self.stop[at][back]]
        stops = (stops + of)[stops < text_ends[of]]
        return np.insert(ids, text_ends, END_ID).astype(np.uint32), counts, stops


    def encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the tokenizer alone; a sentence ends with a token that ends with its mark."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.fromiter((i for part in own for i in part), np.int64, int(sizes.sum()))
        text_ends = np.cumsum(sizes)
        stops = np.flatnonzero(self.marks[ids]) + 1
        of = np.searchsorted(text_ends, stops, "left")
        stops = (stops + of)[stops < text_ends[of]]
        return np.insert(ids, text_ends, END_ID).astype(np.uint32), sizes + 1, stops


def _parts_at_letters(file: dict) -> bool:
    """Whether a tokenizer's file says: lower case, runs of letters on their own, no white space, words end with a mark."""
    normalizer, parted = file["normalizer"] or {}, file["pre_tokenizer"] or {}
    steps = [n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])]
    cuts_up = [p for p in parted.get("pretokenizers", [parted] if parted else [])]
    first = cuts_up[0] if cuts_up else {}
    letters = "[\\p{L}]+" in first.get("pattern", {}).get("Regex", "") and "[^\\s\\p{L}\\p{N}]+" in first["pattern"]["Regex"]
    return (
        set(steps) <= {"NFC", "Replace", "Lowercase"}
        and "Lowercase" in steps
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and letters
        and file["model"].get("end_of_word_suffix") == "</w>"
        and not file["model"].get("dropout")
    )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def cuts(counts: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, and what ending there costs besides padding."""
    text_ends = np.cumsum(counts)
    places = np.union1d(text_ends, sentence_ends)
    cost = np.where(np.isin(places, text_ends), 0.0, SENTENCE_CUT)
    before = np.concatenate(([0], places[:-1]))
    steps = np.maximum(-(-(places - before) // LONGEST_UNCUT), 1)
    if (steps > 1).any():
        nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        cost = np.where(nth == np.repeat(steps, steps), np.repeat(cost, steps), WORD_CUT)
        places = np.where(
            nth == np.repeat(steps, steps), np.repeat(places, steps), np.repeat(before, steps) + nth * LONGEST_UNCUT
        )
    return places, cost


def best_windows(places: np.ndarray, cost: np.ndarray, capacity: int, closed: bool) -> list[int]:
    """Ends of the windows from 0 to the last place that cost least.

    A window that ends at place p and began at q costs its padding, capacity - (p -
    q), and the cost of p. The least cost up to p is ``capacity - p + cost(p)``
    plus the least of ``best(q) + q`` over the q one capacity back; candidates are
    held in a queue of rising values, so each place enters and leaves once. The
    last window is not padded: it is cut at powers of two, each cut costs
    ``WORD_CUT``. With ``closed`` false the last window is free.
    """
    at, extra = [0, *places.tolist()], [0.0, *cost.tolist()]
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    value = [0.0] * len(at)
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - capacity:
            queue.popleft()
        i = queue[0]
        best[j] = value[i] + capacity - p + extra[j]
        came[j] = i
        v = value[j] = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    if j:
        total = at[j]
        tail = [i for i in range(int(np.searchsorted(at, total - capacity)), j)]
        came[j] = min(tail, key=lambda i: best[i] + (WORD_CUT * (int(total - at[i]).bit_count() - 1) if closed else 0.0))
    ends = []
    while j:
        ends.append(at[j])
        j = came[j]
    return ends[::-1]


def _pieces(tables: Iterator[pa.Table], path: str, capacity: int, first_id: int, with_ids: bool, by_words: bool | None = None) -> Iterator[list[tuple]]:
    """Lists of pieces ``id, start, length, crc, tokens, sequence, offset[, ids]``."""
    encoder, sequence = Encoder(path, by_words), first_id
    ids, counts, stops, owners = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    begun = 0  # tokens of the first held document that are packed already

    def packed(ends: list[int]) -> list[tuple]:
        nonlocal sequence
        heads = np.cumsum(counts) - counts
        rows, lo = [], 0
        doc = 0
        for hi in ends:
            while doc < len(heads) and (heads[doc] < hi):
                a, b = max(lo, int(heads[doc])), min(hi, int(heads[doc] + counts[doc]))
                if a < b:
                    skipped = begun if doc == 0 else 0
                    part = ids[a:b]
                    row = (owners[doc], a - int(heads[doc]) + skipped, b - a, zlib.crc32(part.astype("<u4").tobytes()), int(counts[doc]) + skipped, sequence, a - lo)
                    rows.append((*row, part) if with_ids else row)
                if heads[doc] + counts[doc] > hi:
                    break
                doc += 1
            lo, sequence = hi, sequence + 1
        return rows

    for table in tables:
        own_ids, own_counts, own_stops = encoder.encode(table.column("text").combine_chunks())
        stops = np.concatenate((stops, own_stops + len(ids)))
        ids = np.concatenate((ids, own_ids))
        counts = np.concatenate((counts, own_counts))
        owners += table.column("id").to_pylist()
        ends = best_windows(*cuts(counts, stops), capacity, closed=False)[:-2]
        if not ends:
            continue
        yield packed(ends)
        last = ends[-1]
        done = int(np.searchsorted(np.cumsum(counts), last, "right"))
        head = int(counts[:done].sum())
        begun = (begun if done == 0 else 0) + last - head
        ids, stops = ids[last:], stops[stops > last] - last
        counts, owners = counts[done:].copy(), owners[done:]
        if len(counts):
            counts[0] -= last - head
    if len(ids):
        ends = best_windows(*cuts(counts, stops), capacity, closed=True)
        start = ends[-2] if len(ends) > 1 else 0
        rest, tail = ends[-1] - start, []
        for power in reversed(range(capacity.bit_length())):
            if rest >> power & 1:
                start += 1 << power
                tail.append(start)
        yield packed(ends[:-1] + tail)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text: str = "text",
    ids: bool = True,
) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` per piece.

    Each partition is packed on its own, in the order it is stored in, with no
    shuffle: windows end at the ends of documents or sentences so that padding and
    the cost of cuts are least. Every id lies in one piece and no sequence is
    longer than ``capacity``, a power of two. The last window of a partition is
    cut into sequences whose lengths are powers of two and need no padding.

    A document is its ids and a closing id, so a NULL or empty text has one id.
    Rows that repeat are packed as often as they come, a NULL id stays NULL, a long
    text goes over many sequences, an empty table has no pieces. Other columns are
    ignored. ``sequence_id`` holds the partition's number above its lower 40 bits.
    A task holds about ``CHUNK_BYTES`` of text at a time, or one longer text.
    """
    kind, by_words = dict(docs.dtypes)[id_col], Encoder(tokenizer).by_words
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = [pa.int64()] * 6
    if ids:
        schema += ", ids array<int>"
        arrow.append(pa.list_(pa.int32()))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrow)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id, id_type = TaskContext.get().partitionId() << 40, None

        def tables() -> Iterator[pa.Table]:
            nonlocal id_type
            for table in slices(batches, CHUNK_BYTES):
                id_type = table.schema.field("id").type
                yield table

        for rows in _pieces(tables(), tokenizer, capacity, first_id, ids, by_words):
            for at in range(0, len(rows), 2_000):
                columns = list(zip(*rows[at : at + 2_000]))
                arrays = [pa.array(columns[0], id_type), *[pa.array(c, t) for c, t in zip(columns[1:7], arrow)]]
                if ids:
                    ends = np.cumsum([0, *columns[2]], dtype=np.int32)
                    values = pa.array(np.concatenate(columns[7]).view(np.int32))
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), values))
                yield pa.RecordBatch.from_arrays(arrays, ["id", *names])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
