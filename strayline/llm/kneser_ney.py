"""Quality by the perplexity of a modified Kneser-Ney pair model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut, job
from strayline.llm.interpolation import asks_of, batches_of, different, keys_of, pack_numbers, tokens_of, unpack_numbers
from strayline.llm.tokens import slices, sums_by

#: This share of the trusted documents, by a hash of the id, trains the model; the others set
#: the thresholds.
TRAINED_SHARE = 0.8
#: The trained pairs are counted in so many passes, each for its share of all pairs, and of more
#: than ``PASS_BYTES`` of text a share of the batches is scored in each, so that only that share
#: is shuffled at a time.
PASSES, PASS_BYTES = 3, 64 << 20
#: A shard of words and one of pairs for every slice of about so many bytes of text, with
#: ``ROW_BYTES`` more for each row.
FEWEST_SHARDS, SLICE_BYTES, ROW_BYTES = 8, 16 << 20, 256
BATCH_BYTES = 4 << 20
#: A language with fewer trusted documents to measure takes the threshold of all.
LEAST_DOCUMENTS = 50
#: The threshold is this quantile of the log10 perplexity of trusted text of the same
#: language and length class, whose spread is all the allowance a short text gets.
QUANTILE = 0.98
#: Classes of length hold about equally many measured documents, LEAST_DOCUMENTS at
#: least; there are 1, 2, 4, 8 or so many.
MOST_CLASSES = 16


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def unit(id_col: str | Column, seed: int = 10) -> Column:
    """A number in [0, 1) hashed from the id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    hashed = F.xxhash64(F.lit(seed), F.coalesce(column.cast("string"), F.lit("")))
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many counts are 1, 2, 3 and 4.

    Where a number is 0 the estimate is undefined and half of the count is taken;
    no discount exceeds its count.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = [(n1, n2), (n2, n3), (n3, n4)]
    found = [k + 1 - (k + 2) * y * b / a if a and b else (k + 1) / 2 for k, (a, b) in enumerate(ratio)]
    return tuple(min(max(d, 0.05 * (k + 1)), k + 1.0) for k, d in enumerate(found))


def _left_over(count: str, d: tuple[float, float, float]) -> Column:
    c = F.col(count)
    return F.sum(F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))


@dataclass
class Words:
    """The model but for its pair counts.

    ``table`` has for each trained word ``key``, the different words before it (``cont``), how often
    it is a context (``all``), of how many pairs (``types``), and how many of these stand there once and
    twice (``n1``, ``n2``). ``unknown`` is the share of any other word, ``total`` the number
    of different pairs; ``pairs`` and ``conts`` are the discounts of their counts.
    """

    table: DataFrame
    unknown: float
    total: int
    pairs: tuple[float, float, float]
    conts: tuple[float, float, float]

    def share(self, cont: np.ndarray) -> np.ndarray:
        """Continuation probabilities."""
        return np.maximum(cont - np.array([0.0, *self.conts])[np.minimum(cont, 3)], 0.0) / self.total + self.unknown

    def follow(self, times: np.ndarray, types: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """A context's left-over mass, 1 for one that was not trained."""
        d = self.pairs
        return np.where(times > 0, (d[0] * n1 + d[1] * n2 + d[2] * (types - n1 - n2)) / np.maximum(times, 1), 1.0)


def train(trusted: DataFrame, text: str) -> tuple[Words, DataFrame]:
    """The model of all given documents: what is known of its words, and the texts whose pairs count.

    Pairs are counted in the tasks and summed by Spark, a share of them in each pass; of
    a pass only sums by word are written. Discounts, continuation probabilities and
    left-over masses are aggregates of those. Nothing but ten sums reaches the driver.
    """
    texts = trusted.select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    def counter(turn: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in slices(batches, BATCH_BYTES):
                token, before, _ = tokens_of(table.column("text").combine_chunks())
                key = keys_of(token, before)[1]
                mine = np.flatnonzero(key % np.uint64(PASSES) == turn)
                order = mine[np.argsort(key[mine])]
                first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))[: len(order)]
                n = np.diff(np.append(first, len(order)))
                at = order[first]
                names = [_signed(keys_of(x[at], x[at])[0]) for x in (before, token)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*names, n)], ["u", "w", "n"])

        return count

    parts = []
    sums = ["cont", "all", "types", "n1", "n2", "n3", "n4"]
    for turn in range(PASSES):
        pairs = texts.mapInArrow(counter(turn), "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n"))
        zero = F.lit(0).cast("long")
        given = [F.col("n").alias("all"), F.lit(1).cast("long").alias("types"), *[(F.col("n") == k).cast("long").alias(f"n{k}") for k in range(1, 5)]]
        as_context = F.struct(F.col("u").alias("key"), zero.alias("cont"), *given)
        as_word = F.struct(F.col("w").alias("key"), F.lit(1).cast("long").alias("cont"), *[zero.alias(c) for c in sums[1:]])
        both = pairs.select(F.inline(F.array(as_context, as_word)))
        parts.append(cut(both.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    words = cut(every.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums]))
    whole = words.agg(
        *[F.sum(c).alias(c) for c in sums], *[F.count(F.when(F.col("cont") == k, 1)).alias(f"e{k}") for k in range(1, 5)]
    ).first()
    d = discounts([whole[f"n{k}"] or 0 for k in range(1, 5)])
    e = discounts([whole[f"e{k}"] for k in range(1, 5)])
    left = words.agg(F.count(F.lit(1)).alias("types"), _left_over("cont", e).alias("left")).first()
    total, types = whole["types"] or 1, left["types"]
    anything = (left["left"] if types else 1.0) / total / (types + 1)
    return Words(words.select("key", *_KNOWN), float(anything), total, d, e), texts


_KNOWN = ["cont", "all", "types", "n1", "n2"]


def score(docs: DataFrame, words: Words, learned: DataFrame, id_col: str, text: str, language: str) -> DataFrame:
    """``_id, _language, _print, n_tokens, score``: log10 probability of every row's text.

    As in ``interpolation``, documents are gathered into batches, and a batch asks each shard
    for its different words and pairs. The trained texts ``learned`` send the counts of their pairs
    to the same shards, the model's words lie there too, and what is known goes back to the batch.
    The input is read twice and has to give the same rows in the same partitions; if not, the job fails.
    """
    kind = dict(docs.dtypes)[id_col]
    whole = F.coalesce(F.col(text), F.lit(""))
    # Of what is scored nothing is counted, and no batches are kept apart.
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(language).cast("string").alias("language"), F.xxhash64(whole).alias("print"), whole.alias("text"),
        F.lit(0).alias("fold"), F.lit(True).alias("held_out"),
    )
    size = narrow.agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("n")).first()["n"] or 0
    shards = int(max(FEWEST_SHARDS, -(-size // SLICE_BYTES)))
    told = learned.select("text", F.lit(0).alias("fold"), F.lit(False).alias("held_out"))
    told = asks_of(told, shards, orders=(1,)).withColumn("batch", F.lit(-1).cast("long"))
    turns = PASSES if size > PASS_BYTES else 1
    edges = np.array(_edges(shards), np.uint64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("key")).astype(np.int64).view(np.uint64)
            shard = np.searchsorted(edges, keys, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns], ["shard", *batch.schema.names])

    table = words.table.mapInArrow(place, "shard int, key long, " + ", ".join(f"{c} long" for c in _KNOWN))
    names, types = ["batch", "shard", "n", "mark", "found"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        asked = list(zip(*(left.column(c).to_pylist() for c in ("batch", "shard", "n"))))
        unpacked = (np.cumsum(unpack_numbers(k.as_py(), a[2]), dtype=np.uint64) for k, a in zip(left.column("keys"), asked))
        if asked and asked[0][1] < shards:
            order = np.argsort(np.asarray(right.column("key")))
            known = np.asarray(right.column("key"))[order]
            values = [np.asarray(right.column(c))[order] for c in _KNOWN]
            for (batch, shard, n), keys in zip(asked, unpacked):
                at = np.minimum(np.searchsorted(known, _signed(keys)), max(len(known) - 1, 0))
                hit = known[at] == _signed(keys) if len(known) else np.zeros(n, bool)
                found = np.zeros((len(_KNOWN), n), np.int64)
                for to, value in zip(found, values):
                    to[hit] = value[at[hit]]
                rows.append((batch, shard, n, _mark(keys), pack_numbers(found.ravel())))
        elif asked:
            keys = list(unpacked)
            # The trained pairs are summed first; batches look theirs up one after the other.
            taught = [i for i, a in enumerate(asked) if a[0] < 0]
            counts = [unpack_numbers(left.column("counts")[i].as_py(), asked[i][2]) for i in taught]
            flat = np.concatenate([keys[i] for i in taught]) if taught else np.zeros(0, np.uint64)
            order = np.argsort(flat)
            ordered = flat[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(flat)]
            known = ordered[first]
            totals = np.add.reduceat(np.concatenate(counts)[order], first) if len(flat) else np.zeros(0, np.uint64)
            for (batch, shard, n), own in zip(asked, keys):
                if batch < 0:
                    continue
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                hit = known[at] == own if len(known) else np.zeros(n, bool)
                found = np.zeros(n, np.uint64)
                found[hit] = totals[at[hit]]
                rows.append((batch, shard, n, _mark(own), pack_numbers(found)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names)

    model = Words(None, words.unknown, words.total, words.pairs, words.conts)
    discount = np.array([0.0, *words.pairs])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError(_OTHER)
        token, before, sizes = tokens_of(left.column("text").combine_chunks())
        keys = keys_of(token, before)
        got: list[dict[int, tuple]] = [{}, {}]
        for shard, n, mark, found in zip(*(right.column(c).to_pylist() for c in ("shard", "n", "mark", "found"))):
            got[shard // shards][shard % shards] = (n, mark, found)
        held = []
        for order, width in ((0, len(_KNOWN)), (1, 1)):
            own, _ = different(keys[order])
            parts = [got[order][s] for s in sorted(got[order])]
            if sum(p[0] for p in parts) != len(own) or sum(p[1] for p in parts) & _WHOLE != _mark(own) & _WHOLE:
                raise RuntimeError(_OTHER)
            numbers = [unpack_numbers(p[2], width * p[0]).reshape(width, -1) for p in parts]
            back = np.searchsorted(own, keys[order])
            held.append((np.concatenate(numbers, axis=1) if numbers else np.zeros((width, 0), np.uint64), back))
        (of_words, back), (of_pairs, pair) = held
        cont, times, *of_context = of_words.astype(np.int64)
        share, follow = model.share(cont), model.follow(times, *of_context)
        # The context of a text's first word is the end of the text.
        context = np.arange(len(token)) - 1
        heads = np.cumsum(sizes) - sizes
        context[heads] = heads + sizes - 1
        u, count = back[context], of_pairs[0][pair].astype(np.int64)
        own = np.maximum(count - discount[np.minimum(count, 3)], 0.0) / np.maximum(times[u], 1.0)
        total = sums_by(np.log10(own + follow[u] * share[back]), sizes)
        return pa.table(
            [*[left.column(c) for c in ("id", "language", "print")], pa.array(sizes), pa.array(total)],
            ["_id", "_language", "_print", "n_tokens", "score"],
        )

    def dealer(turn: int):
        def with_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = ["id", "language", "print", "text"]
            for number, table in batches_of(batches, TaskContext.get().partitionId()):
                if (number >> 1) % turns == turn:
                    for part in table.select(columns).to_batches(max_chunksize=500):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number, np.int64)), *part.columns], ["batch", *columns])

        return with_batch

    scored = None
    for turn in range(turns):
        with job(docs.sparkSession) as own:
            asks = asks_of(narrow.select("text", "fold", "held_out"), shards, turns, turn).unionByName(told)
            met = asks.groupBy("shard").cogroup(table.groupBy("shard"))
            replies = cut(met.applyInArrow(answer, "batch long, shard int, n long, mark long, found binary"))
            dealt = narrow.mapInArrow(dealer(turn), f"batch long, id {kind}, language string, print long, text string")
            done = dealt.groupBy("batch").cogroup(replies.groupBy("batch"))
            done = own.keep(done.applyInArrow(finish, f"_id {kind}, _language string, _print long, n_tokens long, score double"))
        scored = done if scored is None else scored.unionByName(done)
    return scored


_WHOLE = (1 << 64) - 1
_OTHER = "the input gave other batches when it was read again; write it to a table first"


def _mark(keys: np.ndarray) -> int:
    return int(keys.sum(dtype=np.uint64).astype(np.int64))


def _edges(shards: int) -> list[int]:
    """Where the ranges of names begin that ``_cut_up`` cuts."""
    return [(i << 63) // shards for i in range(shards)]


def _judged(docs: DataFrame, trusted: DataFrame, id_col: str, text: str, language: str) -> DataFrame:
    """``_id, _language, _print, n_tokens, log_perplexity, threshold, kept`` for every row."""
    chosen = cut(trusted.select(F.col(id_col).alias("_t")).filter("_t IS NOT NULL").distinct().withColumn("_unit", unit("_t")))
    with job(docs.sparkSession) as own:
        taught = chosen.filter(F.col("_unit") < TRAINED_SHARE).select("_t")
        learned = cut(docs.select(F.col(id_col).alias("_i"), F.col(text).alias("text")).join(taught, F.col("_i") == F.col("_t"), "left_semi").select("text"))
        words, learned = train(learned, "text")
        scored = score(docs, words, learned, id_col, text, language)
        scored = own.keep(scored.withColumn("log_perplexity", -F.col("score") / F.col("n_tokens")))
    unseen = chosen.filter(F.col("_unit") >= TRAINED_SHARE).select("_t")
    measured = cut(scored.join(unseen, F.col("_id") == F.col("_t"), "left_semi").select("_language", "n_tokens", "log_perplexity"))
    return _limited(scored, measured).withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)))


def _limited(scored: DataFrame, measured: DataFrame) -> DataFrame:
    """``scored`` with ``threshold``, from ``_language, n_tokens, log_perplexity`` of trusted text."""
    limit = F.percentile_approx("log_perplexity", QUANTILE, 10_000)
    edges = F.percentile_approx("n_tokens", [k / MOST_CLASSES for k in range(1, MOST_CLASSES)], 10_000)
    number = F.count(F.lit(1))

    def class_of(edges: str, n: str) -> Column:
        classes = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col(n) / LEAST_DOCUMENTS, F.lit(1.0)))))
        place = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
        return F.floor(place * F.least(classes, F.lit(float(MOST_CLASSES))) / MOST_CLASSES)

    every = cut(measured.agg(limit.alias("_wide"), edges.alias("_wide_edges"), number.alias("_all")))
    own = cut(measured.groupBy(F.col("_language").alias("_l")).agg(limit.alias("_own"), edges.alias("_edges"), number.alias("_n")))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(own, F.col("_language").eqNullSafe(F.col("_l")), "left").join(F.broadcast(every))  # one row
        return rows.withColumn("_class", class_of("_edges", "_n")).withColumn("_wide_class", class_of("_wide_edges", "_all"))

    known = cut(placed(measured).select("_l", "_class", "_wide_class", "log_perplexity"))
    by_class = known.groupBy(F.col("_l").alias("_g"), F.col("_class").alias("_c")).agg(limit.alias("_near"), number.alias("_m"))
    by_class = cut(by_class.filter(F.col("_m") >= LEAST_DOCUMENTS).drop("_m"))
    wide = known.groupBy(F.col("_wide_class").alias("_w")).agg(limit.alias("_wide_near"), number.alias("_m"))
    wide = wide.filter(F.col("_m") >= LEAST_DOCUMENTS).drop("_m")  # at most MOST_CLASSES rows
    same = F.col("_l").eqNullSafe(F.col("_g")) & (F.col("_class") == F.col("_c"))
    return (
        placed(scored)
        .join(by_class, same, "left")
        .join(F.broadcast(wide), F.col("_wide_class") == F.col("_w"), "left")
        .withColumn(
            "threshold",
            F.when(F.col("_n") >= LEAST_DOCUMENTS, F.coalesce("_near", "_own")).otherwise(F.coalesce("_wide_near", "_wide")),
        )
    )


def judged(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang"
) -> DataFrame:
    """``id, n_tokens, perplexity, threshold, kept`` for every row of ``docs``.

    ``trusted`` holds the ids of documents known to be good. The model is trained
    on all of them but one in five; a document is kept if its perplexity per
    token is not above a high quantile of the others of its language and
    length class, which the model has not seen. Texts are whole; a NULL
    or empty text is one token, the end. A language with few trusted documents
    takes the thresholds of all, a class with few that of all lengths. Without any trusted document to
    measure, everything is kept. Repeated rows are judged alike, an empty table gives
    an empty one, and other columns are ignored whatever their names.
    """
    ten = lambda c: F.pow(F.lit(10.0), F.col(c))
    return _judged(docs, trusted, id_col, text, language).select(
        F.col("_id").alias(id_col), "n_tokens", ten("log_perplexity").alias("perplexity"), ten("threshold").alias("threshold"), "kept"
    )


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are judged as ``judged`` does: NULL texts are empty, repeated rows are kept or
    dropped together, an empty table stays empty, and a column may have any name.
    """
    kept = _judged(docs, trusted, id_col, text, language).filter("kept").select("_id", "_print", F.col("_language").alias("_l"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col(f"_row.`{id_col}`").alias("_i"), F.col(f"_row.`{language}`").cast("string").alias("_g"), F.xxhash64(F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))).alias("_p")
    )
    same = rows["_i"].eqNullSafe(kept["_id"]) & (rows["_p"] == kept["_print"]) & rows["_g"].eqNullSafe(kept["_l"])
    return rows.join(kept, same, "left_semi").select("_row.*")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that the labels call good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(id_col)
