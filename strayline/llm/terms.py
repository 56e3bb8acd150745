"""Terms of many texts at once: runs of letters and digits, lower-cased from A to Z.

A term is a maximal run of bytes that are ASCII letters, ASCII digits or part of a
character beyond ASCII. All others part terms, so UTF-8 bytes can be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strayline.llm.tokens import Sums, buffers, pieces

BLANK = 32
_FOLDED = np.full(256, BLANK, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _FOLDED[_low:_high] = np.arange(_low, _high)
_FOLDED[65:91] = np.arange(97, 123)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, blanks where terms are parted, and where each text begins."""
    data, bounds = buffers(texts)
    return _FOLDED[data], bounds


@dataclass
class Piece:
    """Terms of a run of texts, or of a part of a long one."""

    sums: Sums
    text: np.ndarray  # of each term, its text's number
    starts: np.ndarray
    ends: np.ndarray


def term_pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[Piece]:
    """The terms of folded texts, some megabytes at a time."""
    for i, j, lo, hi in pieces(data, bounds):
        part = data[lo:hi]
        if not len(part):
            continue
        inside = part != BLANK
        heads = bounds[i:j] - lo
        heads = heads[(heads >= 0) & (heads < len(part))]
        opens = np.concatenate(([True], ~inside[:-1]))
        opens[heads] = True
        closes = np.concatenate((~inside[1:], [True]))
        closes[heads[heads > 0] - 1] = True
        starts = np.flatnonzero(inside & opens)
        text = i + np.searchsorted(bounds[i + 1 : j + 1], starts + lo, "right")
        yield Piece(Sums(part), text, starts, np.flatnonzero(inside & closes) + 1)


def term_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many terms each folded text has."""
    n = np.zeros(len(bounds) - 1, np.int64)
    for piece in term_pieces(data, bounds):
        n += np.bincount(piece.text, minlength=len(n))
    return n
