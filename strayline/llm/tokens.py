"""Words of many texts at once, as 64-bit numbers, on Arrow buffers.

Only the six ASCII blanks part words, so UTF-8 bytes can be looked at one by one.
A word is the polynomial of its bytes, read off two running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2**64 up to n, and their inverses."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
        for name, factor in (("up", base), ("down", inverse)):
            steps = np.full(n + 1, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"]


class Sums:
    """Hashes of any byte range of one piece."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more than texts)."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(data: np.ndarray, bounds: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """``first text, last text + 1, from, to`` of byte ranges of about ``most`` bytes.

    A range holds whole texts, or a part of one longer text that ends at a blank.
    """
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        lo, end = int(bounds[i]), int(bounds[j])
        while end - lo > most and j == i + 1:
            blank = np.flatnonzero(_BLANK[data[lo + most : end]])[:1] if end - lo > most else []
            if not len(blank):
                break
            hi = lo + most + int(blank[0])
            yield i, j, lo, hi
            lo = hi
        yield i, j, lo, end
        i = j


@dataclass
class Located:
    """The words of all texts in a row: hash, first byte and byte after the last."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words per text


def located(texts: pa.Array, lower: bool = False) -> Located:
    data, bounds = buffers(texts)
    counts = np.zeros(len(bounds) - 1, np.int64)
    found, begins, stops = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, lo, hi in pieces(data, bounds):
        part = data[lo:hi]
        if not len(part):
            continue
        blank = _BLANK[part]
        heads = bounds[i:j] - lo
        heads = heads[(heads >= 0) & (heads < len(part))]
        before = np.concatenate(([True], blank[:-1]))
        before[heads] = True
        after = np.concatenate((blank[1:], [True]))
        after[heads[heads > 0] - 1] = True
        starts = np.flatnonzero(~blank & before)
        ends = np.flatnonzero(~blank & after) + 1
        found.append(Sums(_LOWER[part] if lower else part).of(starts, ends))
        begins.append(starts + lo)
        stops.append(ends + lo)
        cuts = np.searchsorted(starts, np.clip(bounds[i : j + 1] - lo, 0, len(part)))
        counts[i:j] += np.diff(cuts)
    return Located(data, np.concatenate(found), np.concatenate(begins), np.concatenate(stops), counts)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row, and how many words each text has."""
    at = located(texts, lower)
    return at.hashes, at.counts


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values; empty runs give 0."""
    out = np.zeros(len(counts), values.dtype if values.dtype.kind == "f" else np.int64)
    full = counts > 0
    if full.any():
        first = np.cumsum(counts) - counts
        out[full] = np.add.reduceat(values, first[full])
    return out


def slices(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.Table]:
    """The same rows in tables of about ``most`` bytes of text, in order.

    Tables end where the bytes do, not where Arrow's batches end, so they depend
    on the rows of the partition alone.
    """
    held, size = [], 0
    for batch in batches:
        _, bounds = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most - size, "left")))
            to = min(to, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(bounds[to] - bounds[at])
            at = to
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
