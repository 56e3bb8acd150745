"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.tokens import PIECE, _BLANK, Sums, buffers, mix, slices, sums_by

SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 50
#: Buckets of the sketch grow by this factor: a quantile is off by at most 1 %.
GROWTH = 1.02
SMALLEST = 1e-4
#: A group of fewer documents borrows the sketch of its language, then of all.
LEAST_DOCUMENTS = 100
#: Each ratio's bounds: a high quantile of its group, and as much again beyond it, so many
#: times, as the quantile is away from the group's median. Where junk may make up a tenth of
#: a group, a lower quantile is asked, which junk does not reach. The last number is
#: added where all of a group is alike.
RULES = {
    "word_length": (0.9, 4.0, 0.01),
    "symbol_share": (0.9, 4.0, 0.001),
    "repeat_share": (0.99, 1.5, 0.01),
    "dup_line_share": (0.99, 1.5, 0.01),
    "capital_share": (0.99, 1.5, 0.001),
    "mark_share": (0.99, 1.5, 0.001),
}
BOTH_SIDES = ("word_length",)
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]

_IS = {
    "n_symbols": np.isin(np.arange(256), list(SYMBOLS)),
    "word_chars": ~_BLANK & ((np.arange(256) & 0xC0) != 0x80),
    "n_capitals": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "n_marks": np.isin(np.arange(256), list(b"!?;:,._-=/\\~^\"'`()[]{}@+")),
}
SLICE_BYTES = 4 << 20


def _equal_before(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner, how many of its keys equal an earlier one of its keys."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[again], minlength=n)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counted features of each text, over all of it."""
    data, bounds = buffers(texts)
    n = len(bounds) - 1
    out = {f: np.zeros(n, np.int64) for f in _FEATURES}
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1)
        _measure_piece(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], {f: v[i:j] for f, v in out.items()})
        i = j
    return out


def _measure_piece(data: np.ndarray, bounds: np.ndarray, out: dict[str, np.ndarray]) -> None:
    n, size = len(bounds) - 1, len(data)
    if not size:
        return
    for name, table in _IS.items():
        running = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        out[name][:] = running[bounds[1:]] - running[bounds[:-1]]
    blank = _BLANK[data]
    heads = bounds[:-1][(bounds[:-1] < bounds[1:])]
    first = np.zeros(size, bool)
    first[heads] = True
    last = np.zeros(size, bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    before, after = np.concatenate(([True], blank[:-1])) | first, np.concatenate((blank[1:], [True])) | last
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    hashed = Sums(data)
    per_text = np.diff(np.searchsorted(starts, bounds))
    out["n_words"][:] = per_text
    text_of = np.repeat(np.arange(n), per_text)

    newline = data == 10
    line_starts = np.flatnonzero(np.concatenate(([True], newline[:-1])) | first)
    # A text's last line ends before the next text begins, unless a newline closes it.
    following = np.concatenate((line_starts[1:], [size]))
    line_ends = following - newline[following - 1]
    word_at = np.searchsorted(starts, line_starts), np.searchsorted(starts, following)
    lines = word_at[1] > word_at[0]
    line_text = np.searchsorted(bounds, line_starts[lines], "right") - 1
    out["n_lines"][:] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"][:] = _equal_before(hashed.of(line_starts[lines], line_ends[lines]), line_text, n)

    if len(starts) >= 3:
        words = hashed.of(starts, ends)
        keys = mix(mix(words[:-2] + np.uint64(1)) * np.uint64(3) + mix(words[1:-1] + np.uint64(2)) * np.uint64(5) + words[2:])
        inside = text_of[:-2] == text_of[2:]
        at = np.flatnonzero(inside)
        keys = mix(keys[at] + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        often = np.zeros(len(at), bool)
        often[order[1:]] |= same
        often[order[:-1]] |= same
        covered = np.zeros(len(starts), bool)
        for shift in range(3):
            covered[at[often] + shift] = True
        out["n_repeat_words"][:] = sums_by(covered.astype(np.int64), per_text)


def features(docs: DataFrame, id_col: str, text: str, language: str, source: str) -> DataFrame:
    """``_id, _language, _source`` and the counted features of every row."""
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        F.col(language).cast("string").alias("_language"),
        F.col(source).cast("string").alias("_source"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            own = measure(table.column("text").combine_chunks())
            kept = table.select(["_id", "_language", "_source"]).combine_chunks()
            columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in kept.columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(own[f]) for f in _FEATURES]], ["_id", "_language", "_source", *_FEATURES]
            )

    schema = f"_id {kind}, _language string, _source string, " + ", ".join(f"{f} long" for f in _FEATURES)
    return narrow.mapInArrow(run, schema)


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "capital_share": share("n_capitals", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """``_language, _source, ratio, bucket, n``: one mergeable sketch per group and ratio.

    Bucket b holds the values in (GROWTH^(b-1), GROWTH^b]; bucket NULL those below
    ``SMALLEST``. Sketches merge by adding counts, so they are the same in any
    order and on any partitioning, and have at most about 700 buckets.
    """
    value = F.col("ratio.value")
    bucket = F.when(value >= SMALLEST, F.ceil(F.log(value) / float(np.log(GROWTH))).cast("int"))
    return (
        measured.select(
            "_language",
            "_source",
            F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in _ratios().items()])).alias("ratio"),
        )
        .groupBy("_language", "_source", F.col("ratio.name").alias("ratio"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(merged: DataFrame, keys: list[str], shares: dict[str, Column]) -> DataFrame:
    """``keys, n`` and a value per share: an edge of the smallest bucket up to which that share lies.

    It is the lower edge for ``low``, the middle for ``middle`` and the upper edge for any
    other, so that no value of that bucket is beyond it.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-(1 << 30))).alias("b"), F.col("n"))))
    one = merged.groupBy(*keys).agg(pairs.alias("pairs"), F.sum("n").alias("n"))

    def at(name: str, share: Column) -> Column:
        found = F.aggregate(
            "pairs",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("b")),
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when(acc["b"].isNotNull(), acc["b"]).when(acc["seen"] + x["n"] >= share * F.col("n"), x["b"]).alias("b"),
            ),
        )["b"]
        edge = F.pow(F.lit(GROWTH), found) * {"low": 1 / GROWTH, "middle": 2 / (1 + GROWTH)}.get(name, 1.0)
        least = 0.0 if name in ("low", "middle") else SMALLEST
        return F.when(found == -(1 << 30), least).otherwise(edge)

    return one.select(*keys, "n", *[at(name, share).alias(name) for name, share in shares.items()])


def _of_rule(place: int) -> Column:
    """A number of the rule that the row's ratio has."""
    chosen = F.lit(None).cast("double")
    for name, rule in RULES.items():
        chosen = F.when(F.col("ratio") == name, F.lit(rule[place])).otherwise(chosen)
    return chosen


def thresholds(sketch: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``_language, _source`` and ``<ratio>_low, <ratio>_high`` for every group there is."""
    merge = lambda keys: sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    shares = {"low": 1 - _of_rule(0), "middle": F.lit(0.5), "high": _of_rule(0)}
    own = quantiles(sketch, ["_language", "_source", "ratio"], shares)
    of_language = quantiles(merge(["_language", "ratio"]), ["_language", "ratio"], shares).select(
        F.col("_language").alias("_l"), F.col("ratio").alias("_lr"), F.struct("n", *shares).alias("wide")
    )
    of_all = quantiles(merge(["ratio"]), ["ratio"], shares).select(F.col("ratio").alias("_ar"), F.struct(*shares).alias("widest"))
    joined = own.join(
        of_language, own["_language"].eqNullSafe(F.col("_l")) & (own["ratio"] == F.col("_lr"))
    ).join(F.broadcast(of_all), F.col("ratio") == F.col("_ar"))  # a row per ratio

    def pick(side: str) -> Column:
        return (
            F.when(F.col("n") >= least, F.col(side))
            .when(F.col("wide.n") >= least, F.col(f"wide.{side}"))
            .otherwise(F.col(f"widest.{side}"))
        )

    picked = joined.select("_language", "_source", "ratio", *[pick(c).alias(c) for c in shares])
    reach, step = _of_rule(1), _of_rule(2)
    bounded = picked.select(
        "_language",
        "_source",
        "ratio",
        (F.col("low") - reach * (F.col("middle") - F.col("low")) - step).alias("low"),
        (F.col("high") + reach * (F.col("high") - F.col("middle")) + step).alias("high"),
    )
    columns = []
    for name in RULES:
        here = F.col("ratio") == name
        columns.append(F.max(F.when(here, F.col("high"))).alias(f"{name}_high"))
        if name in BOTH_SIDES:
            columns.append(F.max(F.when(here, F.col("low"))).alias(f"{name}_low"))
    return bounded.groupBy("_language", "_source").agg(*columns)


def judged(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source"
) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken``.

    A document is dropped if it fails the fixed base rules, or if one of its
    ratios lies far beyond a high quantile of its language and source
    (``broken`` names the ratios, ``RULES`` the quantiles). They come from sketches of all
    documents that pass the base rules; a small group borrows those of its language, then
    of all. Texts are read once, however long; what is sketched and joined are ten numbers
    a row. A NULL text is empty and fails, a NULL language or source is a group of its own,
    repeated rows are judged alike, an empty table gives an empty one, and other columns
    are ignored whatever their names.
    """
    measured = cut(features(docs, id_col, text, language, source))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bounds = cut(thresholds(sketches(measured.filter(~failed)))).withColumnsRenamed({"_language": "_l", "_source": "_s"})
    rows = measured.withColumn("base_failed", failed).withColumns(_ratios())
    same = F.col("_language").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    outside = [
        F.when(
            (F.col(name) > F.col(f"{name}_high"))
            | ((F.col(name) < F.col(f"{name}_low")) if name in BOTH_SIDES else F.lit(False)),
            F.lit(name),
        )
        for name in RULES
    ]
    return rows.join(bounds, same, "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.concat_ws(",", *outside) == "")).alias("kept"),
        F.concat_ws(",", *outside).alias("broken"),
    )
