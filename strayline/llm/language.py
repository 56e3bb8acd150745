"""Language identification by bit-sliced Bloom filters over letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.llm.tokens import buffers, mix, slices, sums_by

#: A trigram belongs to a language if it makes up so much of its trigrams at least;
#: so no language has more than 1 / RAREST of them.
RAREST = 5e-5
#: Rows of the filter per trigram of the largest language, and hashes per trigram.
ROWS_PER_GRAM, HASHES = 16, 3
MOST_ROWS = 1 << 21
SLICE_BYTES = 4 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per letter, it and its neighbours as one number, and how many letters each text has.

    Texts are lower-cased; whatever is no letter counts as a blank, and a text has
    blanks around it. The number holds the three code points, so it is exact.
    """
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, _ = buffers(lowered)
    sizes = np.asarray(pc.utf8_length(lowered)).astype(np.int64)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.uint64)
    codes = np.where(_letters()[codes], codes, np.uint64(0))
    ends = np.cumsum(sizes)
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    full = sizes > 0
    before[(ends - sizes)[full]] = 0
    after[ends[full] - 1] = 0
    inside = codes > 0
    keys = (before << np.uint64(42) | codes << np.uint64(21) | after)[inside]
    running = np.concatenate(([0], np.cumsum(inside)))
    return keys, running[ends] - running[ends - sizes]


@dataclass
class Filter:
    """Row r of ``masks`` has bit l set if a trigram of language l hashes to r."""

    languages: list[str]
    masks: np.ndarray  # uint64 [rows, words]

    @classmethod
    def of(cls, languages: list[str], language: np.ndarray, keys: np.ndarray) -> Filter:
        most = int(np.bincount(language, minlength=1).max()) if len(language) else 1
        rows = min(MOST_ROWS, 1 << max(6, (ROWS_PER_GRAM * most - 1).bit_length()))
        masks = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
        bit = np.uint64(1) << (language % 64).astype(np.uint64)
        for place in cls.places(keys, rows):
            np.bitwise_or.at(masks, (place, language // 64), bit)
        return cls(languages, masks)

    @staticmethod
    def places(keys: np.ndarray, rows: int) -> list[np.ndarray]:
        hashed = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        return [((hashed >> np.uint64(21 * i)) & np.uint64(rows - 1)).astype(np.int64) for i in range(HASHES)]

    def false_rates(self) -> np.ndarray:
        """Per language, the chance that a trigram that is not in it seems to be."""
        shares = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(shares) ** HASHES

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        One look-up gives the set of languages that hold a trigram. The hits of a
        language, less those expected to be false, as a share of all trigrams, are
        its score; the first language in code point order wins a tie.
        """
        keys, counts = trigrams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        places = self.places(keys, len(self.masks))
        scores = np.zeros((len(self.languages), len(texts)))
        false = self.false_rates()
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            held = column[places[0]]
            for place in places[1:]:
                held &= column[place]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits = sums_by(((held >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64), counts)
                scores[i] = (hits - counts * false[i]) / max(1 - false[i], 1e-9) / np.maximum(counts, 1)
        best = scores.argmax(axis=0)
        names = [self.languages[b] if c else UNKNOWN for b, c in zip(best, counts)]
        return names, np.where(counts > 0, np.clip(scores[best, np.arange(len(texts))], 0, 1), 0.0)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``fold``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang") -> Filter:
    """The filter of all documents that are not held out and have text and language.

    Trigrams are counted per slice in the tasks and summed by Spark. What reaches
    the driver are at most 1 / ``RAREST`` trigrams per language.
    """
    known = docs.filter(~held_out(id_col) & F.col(text).isNotNull() & F.col(language).isNotNull()).select(
        F.col(text).alias("text"), F.col(language).alias("language")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            keys, counts = trigrams(table.column("text").combine_chunks())
            names = table.column("language").to_pylist()
            order = {name: i for i, name in enumerate(dict.fromkeys(names))}
            owner = np.repeat([order[n] for n in names], counts)
            for name, i in order.items():
                own, n = np.unique(np.sort(keys[owner == i]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["language", "gram", "n"],
                )

    counted = known.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("language").agg(F.sum("n").alias("all")).withColumnRenamed("language", "_own")
    common = counted.join(totals, F.col("language") == F.col("_own")).filter(F.col("n") >= RAREST * F.col("all"))
    rows = common.select("language", "gram").toArrow()
    found = rows.column("language").to_pylist()
    languages = sorted(set(found), key=lambda s: s.encode())
    place = {name: i for i, name in enumerate(languages)}
    return Filter.of(
        languages,
        np.fromiter((place[n] for n in found), np.int64, len(found)),
        np.asarray(rows.column("gram")).astype(np.uint64),
    )


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score`` for every row, from the text alone.

    A text that is NULL, empty or without a letter is ``und`` with score 0, as is
    every text if nothing was learned. Repeated rows and NULL ids are answered
    like any others; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            table = table.combine_chunks()
            names, scores = shared.value.decide(table.column("text").combine_chunks())
            ids, held = (table.column(c).combine_chunks() for c in ("id", "held"))
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(scores)], ["id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text).alias("text"))
    schema = f"id {kind}, held_out boolean, lang_pred string, score double"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
