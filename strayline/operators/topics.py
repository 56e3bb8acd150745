"""Topics of texts by expectation-maximisation over tables of words and documents."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.functions.text import hash_unit
from strayline.lineage import cut, job
from strayline.operators.moments import matrix_of

#: A word: what lies between ASCII blanks, in lower case.
WORD = r"[^\x20\x09-\x0D]+"
#: About so many counts, and bytes of their words, are a batch of documents, which one task holds; small
#: tables have some batches, too, of a few counts at least.
BATCH_COUNTS, BATCH_BYTES, FEWEST_COUNTS = 4_000_000, 128 << 20, 50_000
#: Counts that a task works on at a time.
CHUNK_COUNTS = 1 << 18
#: Of the gamma distribution that first weights are drawn from.
GAMMA_SHAPE = 100.0


def word_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc, word, n``: how often each word is in each document, all words of a document in one partition."""
    texts = dealt(df.select(F.col(id_col).alias("doc"), text), "doc")
    return counted(texts.select("doc", F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Texts dealt out by document, before they are split: words are never shuffled."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def counted(words: DataFrame) -> DataFrame:
    """``doc, word, n`` of ``doc, word``."""
    return words.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Batches:
    """Counts of words by batches of documents.

    ``docs`` holds ``_batch, doc, at, n``: the places of a document's words in its batch's list, and
    their counts. ``words``, ``_batch, word, at``, are these lists: what is known of a word goes once to
    each batch that has it, and not to each of its documents. ``number`` is how many batches there are.
    """

    docs: DataFrame
    words: DataFrame
    number: int

    def run(
        self, function: Callable[[pa.Table, np.ndarray, pa.Array, pa.Table], pa.Table], schema: str, given: DataFrame,
        k: int, own: DataFrame | None = None, docs: DataFrame | None = None, line: Column | None = None,
    ) -> DataFrame:
        """What ``function`` makes of each batch with documents.

        It gets these, a line of ``k`` numbers for each word of the list, the list and ``own``. ``given`` is
        ``words`` with ``x``, their numbers; ``own``, ``doc, x``, those of documents. ``docs`` are some of all documents.
        ``line`` works the numbers out from ``word`` and ``x`` where they have arrived.
        """
        docs = self.docs if docs is None else docs
        given = given.select(F.col("_batch").alias("_to"), "word", "at", F.lit(None).cast(docs.schema["doc"].dataType).alias("doc"), "x")
        if own is not None:
            nothing = (F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("at"))
            given = given.unionByName(own.select(_batch_of(self.number).alias("_to"), *nothing, "doc", "x"))

        def of_batch(left: pa.Table, right: pa.Table) -> pa.Table:
            listed = pc.is_valid(right.column("at"))
            words = right.filter(listed)
            at = words.column("at").to_numpy()
            lines = np.empty((len(at), k))
            lines[at] = matrix_of(words.column("x"), k)
            order = np.empty(len(at), dtype=np.int64)
            order[at] = np.arange(len(at))
            return function(left, lines, words.column("word").combine_chunks().take(pa.array(order)), right.filter(pc.invert(listed)))

        # Words of a batch without documents are left out.
        needed = given.join(docs.select(F.col("_batch").alias("_to")).distinct(), "_to", "left_semi")
        if line is not None:
            needed = needed.repartition("_to").withColumn("x", line)
        return docs.groupBy("_batch").cogroup(needed.groupBy("_to")).applyInArrow(of_batch, schema)


def _batch_of(number: int) -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(number)).cast("int")


def by_document(counts: DataFrame) -> DataFrame:
    """``doc, held``: the words of each document of ``doc, word, n`` and their counts."""
    return counts.groupBy("doc").agg(F.collect_list(F.struct("word", "n")).alias("held"))


def batches_of(held: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = BATCH_COUNTS) -> Batches:
    """The documents of ``by_document`` in batches of about ``most`` counts; ``keep`` writes them."""
    text = F.aggregate("held", F.lit(0).cast("bigint"), lambda total, h: total + F.octet_length(h["word"]))
    size, in_bytes = (x or 0 for x in held.agg(F.sum(F.size("held")), F.sum(text)).first())
    few = min(2 * held.sparkSession.sparkContext.defaultParallelism, size // FEWEST_COUNTS)
    number = max(1, few, -(-size // most), -(-in_bytes // BATCH_BYTES))
    kind = held.schema["doc"].dataType.simpleString()
    schema = f"_batch int, doc {kind}, ats array<int>, n array<bigint>, word string, at int"
    both = keep(held.withColumn("_batch", _batch_of(number)).groupBy("_batch").applyInArrow(_listed, schema))
    docs = both.filter("word IS NULL").select("_batch", "doc", F.col("ats").alias("at"), "n")
    return Batches(docs, both.filter("word IS NOT NULL").select("_batch", "word", "at"), number)


def _listed(batch: pa.Table) -> pa.Table:
    """A batch's documents, with the places of their words, and its list of words."""
    docs = batch.combine_chunks()
    lists = docs.column("held").combine_chunks()
    pairs = lists.flatten()
    coded = pairs.field("word").dictionary_encode()
    ends = pa.array(_ends(lists), pa.int32())
    places, numbers = (pa.ListArray.from_arrays(ends, x) for x in (coded.indices, pairs.field("n")))
    of_batch = docs.column("_batch")[0]
    names = ["_batch", "doc", "ats", "n", "word", "at"]
    m = len(coded.dictionary)
    kinds = [pa.int32(), docs.schema.field("doc").type, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.int32()]
    columns = [docs.column("_batch"), docs.column("doc"), places, numbers, pa.nulls(len(docs), pa.string()), pa.nulls(len(docs), pa.int32())]
    listed = [pa.repeat(of_batch, m), *[pa.nulls(m, t) for t in kinds[1:4]], coded.dictionary.cast(pa.string()), pa.array(np.arange(m), pa.int32())]
    return pa.concat_tables([pa.table([c.cast(t) for c, t in zip(side, kinds)], names) for side in (columns, listed)])


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among all elements, and the end."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])


def _chunks(docs: pa.Table):
    """``first, last, at, n, starts`` of some documents after the others: their words' places, counts, and where each begins."""
    at, n = (docs.column(c).combine_chunks() for c in ("at", "n"))
    ends, at, n = _ends(at), at.flatten().to_numpy(), n.flatten().to_numpy().astype(float)
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_COUNTS, "right")) - 1)
        yield first, last, at[ends[first] : ends[last]], n[ends[first] : ends[last]], ends[first:last] - ends[first]
        first = last


def _vectors(lines: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * lines.shape[1], pa.int32()), pa.array(lines.ravel()))


def _sums(k: int, column: str) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(c))) for c in range(k)])


def topic_steps(
    counts: DataFrame, k: int, steps: int = 10, alpha: float = 0.1, beta: float = 0.01, seed: int = 0,
    hot_rows: int = BATCH_COUNTS,
) -> tuple[DataFrame, DataFrame]:
    """``doc, topics`` and ``word, topics``: how many words of each document, and occurrences of each word, are of each topic.

    A word in a document is shared out among the topics in proportion to what the
    document has of a topic, plus ``alpha``, times the word's share of the topic, each
    word having ``beta`` more. The first shares hang on a hash of document, word and topic.
    Documents and words are tables; only the topics' ``k`` totals are known to all. A
    step brings what is known of words and documents to batches of about ``hot_rows`` counts, and
    sums the shares of a batch before they leave it.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: hash_unit("doc", "word", seed=c + seed * k) + F.lit(0.5))
    kind = counts.schema["doc"].dataType
    sides = F.array(F.struct("word", F.lit(None).cast(kind).alias("doc")), F.struct(F.lit(None).cast("string").alias("word"), "doc"))
    with job(counts.sparkSession) as own:
        held = cut(by_document(counts))
        # One pass sums by word and by document; the shares themselves are never written.
        listed = held.select("doc", F.inline("held")).select("doc", "word", "n", F.explode(F.array(first)).alias("_w"))
        shared = listed.select("doc", "word", _shared_out("_w", "n").alias("s"))
        found = own.keep(shared.select(F.inline(sides), "s").groupBy("word", "doc").agg(_sums(k, "s").alias("topics")))
        batches = batches_of(held, own.keep, hot_rows) if steps else None
    schema = f"word string, doc {kind.simpleString()}, s array<double>"
    for _ in range(steps):
        of_word, of_doc = found.filter("word IS NOT NULL"), found.filter("word IS NULL").selectExpr("doc", "topics AS x")
        sums = of_word.agg(F.count(F.lit(1)).alias("words"), *[F.sum(F.get("topics", F.lit(c))).alias(f"t{c}") for c in range(k)]).first()
        totals = np.array([(sums[f"t{c}"] or 0.0) + beta * sums["words"] for c in range(k)])
        given = batches.words.join(of_word.selectExpr("word", "topics AS x"), "word")
        with job(counts.sparkSession) as own:
            # What batches gave goes once it is summed.
            shared = cut(batches.run(_shares(totals, alpha, beta), schema, given, k, of_doc))
            found = own.keep(shared.groupBy("word", "doc").agg(_sums(k, "s").alias("topics")))
    return found.filter("word IS NULL").drop("word"), found.filter("word IS NOT NULL").drop("doc")


def _shares(totals: np.ndarray, alpha: float, beta: float):
    """The function that shares out a batch's counts and sums them by word and by document."""

    def share(docs: pa.Table, lines: np.ndarray, words: pa.Array, own: pa.Table) -> pa.Table:
        k = len(totals)
        of_word, by_word, by_doc = (lines + beta) / totals, np.zeros_like(lines), np.empty((len(docs), k))
        place = pc.index_in(docs.column("doc").combine_chunks(), own.column("doc").combine_chunks()).to_numpy()
        of_doc = matrix_of(own.column("x"), k)[place] + alpha
        for first, last, at, n, starts in _chunks(docs):
            s = of_word[at] * np.repeat(of_doc[first:last], np.diff([*starts, len(at)]), axis=0)
            s *= (n / s.sum(axis=1))[:, None]
            by_doc[first:last] = np.add.reduceat(s, starts, axis=0)
            for c in range(k):
                by_word[:, c] += np.bincount(at, s[:, c], len(words))
        names, ids = ["word", "doc", "s"], docs.column("doc").combine_chunks()
        of_words = pa.table([words, pa.nulls(len(words), ids.type), _vectors(by_word)], names)
        return pa.concat_tables([of_words, pa.table([pa.nulls(len(ids), words.type), ids, _vectors(by_doc)], names)])

    return share


def _shared_out(weights: str, n: str) -> Column:
    """``n`` in proportion to the weights."""
    whole = F.aggregate(weights, F.lit(0.0), lambda total, w: total + w)
    return F.transform(weights, lambda w: w * F.col(n) / whole)


def online_topics(
    counts: DataFrame, documents: int, k: int, max_iter: int = 10, seed: int = 0, share: float = 0.05, offset: float = 1024.0, decay: float = 0.51
) -> DataFrame:
    """``doc, topics``: the shares of the topics in each document by online variational Bayes, as MLlib's LDA fits it.

    A step draws a ``share`` of the documents, infers their topics and moves the words' weights towards what
    these documents say of all ``documents``; the topics' own prior moves, too. Weights are numbers hashed
    from the words, all scaled and moved alike, plus what documents have added: a table of the words
    that a step has met. ``k`` sums over the words are all that the driver holds.
    """
    spark = counts.sparkSession
    alpha, eta, scale, moved = np.full(k, 1 / k), 1 / k, 1.0, 0.0
    with job(spark) as own:
        batches = batches_of(cut(by_document(counts)), own.keep)
    start = F.array(*[_drawn(F.col("word"), 2 * (seed * k + c)) for c in range(k)])
    firsts = batches.words.select("word").distinct().select(F.explode(F.array(start)).alias("x"))
    line = firsts.agg(F.count(F.lit(1)).alias("words"), *[F.sum(F.get("x", F.lit(c))).alias(f"t{c}") for c in range(k)]).first()
    n_words, of_start = line["words"], np.array([line[f"t{c}"] or 0.0 for c in range(k)])
    added, of_added = None, np.zeros(k)

    def given() -> tuple[DataFrame, Column]:
        own = F.transform(start, lambda x: x * F.lit(float(scale)) + F.lit(float(moved)))
        if added is None:
            return batches.words.withColumn("x", F.lit(None).cast("array<double>")), own
        more = F.when(F.col("x").isNull(), own).otherwise(F.zip_with(own, "x", lambda x, y: x + y))
        return batches.words.join(added.withColumnRenamed("added", "x"), "word", "left"), more

    def totals() -> np.ndarray:
        return scale * of_start + moved * n_words + of_added

    for step in range(1, max_iter + 1):
        drawn = batches.docs.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "doc"), F.lit(1 << 30)) < int(share * (1 << 30)))
        words, line = given()
        with job(spark) as own:
            found = cut(batches.run(_learned(totals(), alpha, seed + step), "word string, s array<double>, docs bigint", words, k, docs=drawn, line=line))
            phats = found.filter("word IS NULL").agg(F.sum("docs"), *[F.sum(F.get("s", F.lit(c))) for c in range(k)]).first()
            if not phats[0]:
                continue
            weight = (offset + step) ** -decay
            gain = weight * documents / math.ceil(share * documents)
            news = found.filter("word IS NOT NULL").select("word", F.transform("s", lambda x: x * F.lit(float(gain))).alias("s"))
            if added is not None:
                news = news.unionByName(added.select("word", F.transform("added", lambda x: x * F.lit(1 - weight)).alias("s")))
            added = own.keep(news.groupBy("word").agg(_sums(k, "s").alias("added")))
        scale, moved = (1 - weight) * scale, (1 - weight) * moved + weight * eta
        of_added = np.array([x or 0.0 for x in added.agg(*[F.sum(F.get("added", F.lit(c))) for c in range(k)]).first()])
        alpha = _moved_prior(alpha, np.array(phats[1:]) / phats[0], phats[0], weight)
    kind = counts.schema["doc"].dataType.simpleString()
    words, line = given()
    return batches.run(_judged(totals(), alpha, seed), f"doc {kind}, topics array<double>", words, k, line=line)


def _drawn(key: Column, number: int) -> Column:
    """A number near 1 hashed from the key: of a gamma distribution of shape ``GAMMA_SHAPE`` and mean 1."""
    units = [(F.shiftrightunsigned(F.xxhash64(F.lit(number + j), key), 11) + F.lit(0.5)) / F.lit(2.0**53) for j in (0, 1)]
    normal = F.sqrt(F.log(units[0]) * F.lit(-2.0)) * F.cos(units[1] * F.lit(2 * math.pi))
    return F.pow(normal / F.lit(3 * math.sqrt(GAMMA_SHAPE)) + F.lit(1 - 1 / (9 * GAMMA_SHAPE)), 3.0)


def _hashed(keys: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The same for ``k`` numbers of each whole number."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(2 * k) + np.arange(2 * k, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    units = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54
    normal = np.sqrt(-2 * np.log(units[:, :k])) * np.cos(2 * math.pi * units[:, k:])
    return (normal / (3 * math.sqrt(GAMMA_SHAPE)) + 1 - 1 / (9 * GAMMA_SHAPE)) ** 3


def digamma(x: np.ndarray, order: int = 0) -> np.ndarray:
    """The digamma function of numbers above 0, or for ``order`` 1 its derivative."""
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(8):
        low = x < 8
        out = out + np.where(low, 1 / x**2 if order else -1 / x, 0.0)
        x += low
    y = 1 / (x * x)
    if order:
        return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _expected(gamma: np.ndarray) -> np.ndarray:
    """The expected logarithms of Dirichlet distributions, a line each."""
    return digamma(gamma) - digamma(gamma.sum(axis=-1, keepdims=True))


def _moved_prior(alpha: np.ndarray, phat: np.ndarray, n: int, weight: float) -> np.ndarray:
    """A Newton step of the topics' prior, unless a number would fall to 0."""
    slope = n * (phat - _expected(alpha))
    c, q = n * digamma(alpha.sum(), 1), -n * digamma(alpha, 1)
    step = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    new = alpha + weight * step
    return new if (new > 0).all() else alpha


def infer(at: np.ndarray, n: np.ndarray, starts: np.ndarray, words: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topics of documents by variational inference, each until its numbers move by less than 0.001 on average.

    ``gamma``, ``exp`` of its expected logarithms, and each count by what its word is expected to have.
    """
    gamma, lengths = gamma.copy(), np.diff([*starts, len(at)])
    shares, ratios = np.exp(_expected(gamma)), np.empty(len(at))
    # What is left of the documents and of their counts.
    docs, rows, lines, counts = np.arange(len(starts)), np.arange(len(at)), words[at], n
    of = np.repeat(docs, lengths)
    ratio = counts / (np.einsum("ij,ij->i", lines, shares[of]) + 1e-100)
    while len(docs):
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        new = shares[docs] * np.add.reduceat(lines * ratio[:, None], begin, axis=0) + alpha
        change = np.abs(new - gamma[docs]).mean(axis=1)
        gamma[docs], shares[docs] = new, np.exp(_expected(new))
        ratio = counts / (np.einsum("ij,ij->i", lines, shares[of]) + 1e-100)
        going = ~(change <= 1e-3)
        if not going.all():
            kept = np.repeat(going, lengths)
            ratios[rows[~kept]] = ratio[~kept]
            docs, lengths, rows, lines, counts, of, ratio = docs[going], lengths[going], rows[kept], lines[kept], counts[kept], of[kept], ratio[kept]
    return gamma, shares, ratios


def _learned(totals: np.ndarray, alpha: np.ndarray, seed: int):
    """The function that infers the topics of drawn documents: what they say of words, and the sum of their expected logarithms."""

    def learn(docs: pa.Table, lines: np.ndarray, words: pa.Array, _: pa.Table) -> pa.Table:
        k = len(alpha)
        own, first_gamma = np.exp(digamma(lines) - digamma(totals)), _hashed(docs.column("doc").to_numpy(), k, seed)
        by_word, met, logs = np.zeros_like(lines), np.zeros(len(words), dtype=bool), np.zeros(k)
        for first, last, at, n, starts in _chunks(docs):
            gamma, shares, ratios = infer(at, n, starts, own, alpha, first_gamma[first:last])
            logs += _expected(gamma).sum(axis=0)
            met[at] = True
            given = np.repeat(shares, np.diff([*starts, len(at)]), axis=0) * ratios[:, None]
            for c in range(k):
                by_word[:, c] += np.bincount(at, given[:, c], len(words))
        told = [*(by_word * own)[met], logs]
        names = pa.concat_arrays([words.filter(pa.array(met)), pa.nulls(1, pa.string())])
        number = pa.array([0] * (len(told) - 1) + [len(docs)], pa.int64())
        return pa.table([names, _vectors(np.array(told)), number], ["word", "s", "docs"])

    return learn


def _judged(totals: np.ndarray, alpha: np.ndarray, seed: int):
    """The function that gives the topics' shares of a batch's documents."""

    def judge(docs: pa.Table, lines: np.ndarray, words: pa.Array, _: pa.Table) -> pa.Table:
        own, gammas = np.exp(digamma(lines) - digamma(totals)), _hashed(docs.column("doc").to_numpy(), len(alpha), seed)
        for first, last, at, n, starts in _chunks(docs):
            gammas[first:last] = infer(at, n, starts, own, alpha, gammas[first:last])[0]
        return pa.table([docs.column("doc"), _vectors(gammas / gammas.sum(axis=1, keepdims=True))], ["doc", "topics"])

    return judge


def table_topics(
    df: DataFrame, id_col: str, text: str, k: int = 10, steps: int = 10, alpha: float = 0.1, beta: float = 0.01, seed: int = 0
) -> DataFrame:
    """Adds ``topic`` and ``topic_weights`` to each text, without a table of words on the driver.

    Weights are a document's shares of the topics, ``alpha`` words added to each; the lowest
    topic wins ties. Rows that share an id are one document. A NULL id, or a text without
    words, has no topic: NULL.
    """
    of_doc, _ = topic_steps(word_counts(df.filter(F.col(id_col).isNotNull()), id_col, text), k, steps, alpha, beta, seed)
    whole = F.aggregate("topics", F.lit(0.0), lambda total, x: total + x) + F.lit(k * float(alpha))
    weights = F.transform("topics", lambda x: (x + F.lit(float(alpha))) / whole)
    found = of_doc.select(F.col("doc").alias("_doc"), weights.alias("topic_weights"))
    joined = df.join(found, F.col(id_col) == F.col("_doc"), "left").drop("_doc")
    return joined.withColumn("topic", (F.array_position("topic_weights", F.array_max("topic_weights")) - 1).cast("int"))
