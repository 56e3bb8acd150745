"""Toxicity by non-negative learning from confirmed toxic and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.language import held_out
from strayline.llm.rows import whole_text
from strayline.llm.terms import folded, term_pieces
from strayline.llm.tokens import mix, slices

#: The classifiers are trained on about so many confirmed toxic rows and unlabelled
#: rows at most, taken by a hash of id and text, and on about so many bytes of each.
MOST_TOXIC, MOST_UNLABELLED, MOST_BYTES = 2_000, 8_000, 32 << 20
#: Each classifier has its own part of the unlabelled sample; their mean decides.
CLASSIFIERS = 4
FOLDS, HELD_FOLD = 5, 0
FEATURES = 1 << 18
#: Besides whole terms, their first bytes are features, so that new forms of a word
#: are known by their beginning.
PREFIXES = (3, 4, 5, 6, 7)
#: Length of a text's feature vector, rounds of training, first step and pull to 0.
LENGTH, ROUNDS, STEP, PULL = 8.0, 60, 0.3, 3e-4
SLICE_BYTES = 4 << 20


@dataclass
class Features:
    """Non-zero features of texts, by text."""

    text: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    texts: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights=weights[self.feature] * self.value, minlength=self.texts)

    def sums(self, per_text: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, weights=per_text[self.text] * self.value, minlength=FEATURES)


def features(texts: pa.Array) -> Features:
    """Roots of the counts of terms and their beginnings, scaled to one length per text."""
    data, bounds = folded(texts)
    found, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for piece in term_pieces(data, bounds):
        keys = [piece.sums.of(piece.starts, piece.ends)]
        owners = [piece.text]
        for size in PREFIXES:
            longer = piece.ends - piece.starts > size
            start = piece.starts[longer]
            keys.append(piece.sums.of(start, start + size) + np.uint64(size))
            owners.append(piece.text[longer])
        place = (mix(np.concatenate(keys)) % np.uint64(FEATURES)).astype(np.int64)
        key, n = np.unique(np.concatenate(owners) * FEATURES + place, return_counts=True)
        found.append(key)
        numbers.append(n)
    key, inverse = np.unique(np.concatenate(found), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(numbers), minlength=len(key))
    text, feature = key // FEATURES, key % FEATURES
    total = np.bincount(text, weights=n, minlength=len(bounds) - 1)
    value = LENGTH * np.sqrt(n / total[text])
    return Features(text.astype(np.int32), feature.astype(np.int32), value.astype(np.float32), len(bounds) - 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def risk(z: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Estimated logistic risk of toxic text and of other text.

    The second takes the toxic share's part from the risk of calling unlabelled text
    toxic; its true value is not negative.
    """
    positive = prior * _softplus(-z[toxic]).mean()
    negative = _softplus(z[~toxic]).mean() - prior * _softplus(z[toxic]).mean()
    return float(positive), float(negative)


def slope(z: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """The step's direction per text: where the second risk is negative, only back up that."""
    score = _logistic(z)
    of_toxic, of_other = prior * toxic / toxic.sum(), ~toxic / (~toxic).sum()
    negative = (of_other - of_toxic) * score
    if risk(z, toxic, prior)[1] < 0:
        return -negative
    return negative - of_toxic * (1.0 - score)


def fit(parts: list[Features], toxic: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier, most weights being 0.

    ``parts`` are the features of the texts that ``toxic`` marks, in order. Adaptive gradient steps on the estimated risk, each followed by a pull of every
    weight to 0, so that features that tell little have none.
    """
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    bias, bias_squares = 0.0, 1e-8
    cuts = np.cumsum([p.texts for p in parts])[:-1]
    for _ in range(ROUNDS):
        per_text = slope(np.concatenate([p.times(weights) for p in parts]) + bias, toxic, prior)
        gradient = sum(p.sums(own) for p, own in zip(parts, np.split(per_text, cuts)))
        squares += gradient**2
        rate = STEP / np.sqrt(squares)
        weights -= rate * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * PULL, 0.0)
        down = per_text.sum()
        bias_squares += down**2
        bias -= STEP * down / np.sqrt(bias_squares)
    return weights, float(bias)


@dataclass
class Model:
    """The classifiers' mean, a linear one again; none if nothing toxic is known."""

    weights: np.ndarray | None
    bias: float
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return _logistic(features(texts).times(self.weights) + self.bias)


def _drawn(share: float, seed: int, *columns: str) -> Column:
    """Whether a row's hash is in the given share."""
    hashed = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.shiftrightunsigned(hashed, 11) < F.lit(int(min(share, 1.0) * (1 << 53)))


def _sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``_id, text`` and ``MOST_BYTES`` at most, by hash; equal rows are one."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(most / max(size["n"], 1), MOST_BYTES / max(size["bytes"] or 1, 1))
    return rows.filter(_drawn(share, seed, "_id", "text")).dropDuplicates(["_id", "text"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Classifiers of confirmed toxic text against unlabelled text, from rows not held out.

    Only label 1 is looked at as a class. Unlabelled text is a sample of all text that
    is not held out, toxic text included; how much of it is toxic, the class prior, is
    the share of label 1 among the labels that are not held out. An id with several
    labels is toxic if one of them is 1; NULL labels count for nothing.
    """
    known = labels.filter(~held_out(id_col, FOLDS, HELD_FOLD) & F.col(toxic).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_l")).agg((F.max(toxic) == 1).alias("toxic"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).first()
    prior = size["toxic"] / max(size["n"], 1)
    rows = docs.filter(~held_out(id_col, FOLDS, HELD_FOLD)).select(F.col(id_col).alias("_id"), whole_text(text).alias("text"))
    some = cut(known.filter(F.col("toxic") & _drawn(MOST_TOXIC / max(size["toxic"], 1), 3, "_l")).select("_l"))
    # About MOST_TOXIC ids; an id may have several rows, so their rows are drawn from again.
    confirmed = cut(rows.join(F.broadcast(some), F.col("_id") == F.col("_l"), "left_semi"))
    members = F.array(*[F.lit(k) for k in range(CLASSIFIERS)])
    own = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(CLASSIFIERS)).cast("int")
    sample = (
        _sampled(confirmed, MOST_TOXIC, 1)
        .select(F.explode(members).alias("member"), F.lit(True).alias("toxic"), "text")
        .union(_sampled(rows, MOST_UNLABELLED, 2).select(own, F.lit(False), "text"))
    )

    def train(table: pa.Table) -> pa.Table:
        marks = np.asarray(table.column("toxic"))
        if marks.all() or not marks.any():
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.float64())], ["weights", "bias"])
        parts = [features(part.column("text").combine_chunks()) for part in slices(table.to_batches(), SLICE_BYTES)]
        weights, bias = fit(parts, marks, prior)
        return pa.table([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    # CLASSIFIERS rows of FEATURES numbers.
    made = sample.groupBy("member").applyInArrow(train, "weights binary, bias double").collect()
    if not made:
        return Model(None, 0.0, prior)
    weights = np.mean([np.frombuffer(m["weights"], "<f4").astype(float) for m in made], axis=0)
    return Model(weights, float(np.mean([m["bias"] for m in made])), prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row, from the whole text alone.

    A text without terms, NULL and empty included, gets the score of no evidence.
    Where nothing toxic was known, every score is 0. Very long texts are read in
    pieces of some megabytes. Repeated rows and NULL ids are scored like any others,
    an empty table gives an empty one, and other columns are ignored whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            table = table.combine_chunks()
            scores = shared.value.score(table.column("text").combine_chunks())
            ids, held = (table.column(c).combine_chunks() for c in ("id", "held"))
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores), predicted], ["id", "held_out", "score", "predicted"])

    narrow = docs.select(
        F.col(id_col).alias("id"), held_out(id_col, FOLDS, HELD_FOLD).alias("held"), whole_text(text).alias("text")
    )
    schema = f"id {kind}, held_out boolean, score double, predicted int"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
