"""Language-model scores by deleted interpolation.

Counts of words and word pairs are kept in shards. Documents are gathered into
batches; a batch asks each shard for its different words and pairs and gets their
counts back, so a word that is in every document moves once per batch, and no
task ever holds all occurrences or all counts of anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.tokens import mix, slices, sums_by, words

BATCH_BYTES = 6 << 20
SHARD_BYTES = 16 << 20
#: With more shards, asks go by way of ranges of shards: batches times shards would grow
#: with the square of the corpus.
DIRECT_SHARDS = 512
#: The token that ends a text and is the context of its first word.
END = np.uint64(0x5851F42D4C957F2D)
#: One training document in so many is held out when the mixture weights are learned.
HELD_OUT_FOLDS = 8
#: Twice as many as a count has binary digits: no bucket is open to the top.
BUCKETS = 128
STEP = 2.0  # cells of the held-out table per halving of a probability
ROUNDS = 200


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, squeezed: small ones take little room."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one end per text, the word before each, and tokens per text."""
    found, counts = words(texts, lower=True)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    token = np.empty(len(found) + len(counts), np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[ends], token[inner] = END, found
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - counts] = END
    return token, before, sizes


def keys_of(token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit names of each token and of each pair."""
    return mix(token) >> np.uint64(1), mix(mix(before + np.uint64(7)) * np.uint64(3) + token) >> np.uint64(1)


def different(keys: np.ndarray, learned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The different keys, sorted, and how often each stands in what is learned from."""
    if learned is None:
        keys = np.sort(keys)
        return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys, None
    marked = np.sort(keys << np.uint64(1) | learned.astype(np.uint64))
    keys = marked >> np.uint64(1)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)


def batches_of(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables of about ``BATCH_BYTES`` with a number; the lowest bit tells held-out ones.

    Documents that the weights are learned on go to batches of their own.
    """
    made = [0, 0]
    held: list[list[pa.RecordBatch]] = [[], []]
    size = [0, 0]

    def flush(kind: int) -> tuple[int, pa.Table]:
        number = (task << 24 | made[kind]) << 1 | kind
        table = pa.Table.from_batches(held[kind])
        made[kind], held[kind], size[kind] = made[kind] + 1, [], 0
        return number, table

    for table in slices(batches, BATCH_BYTES // 4):
        for kind in (0, 1):
            own = table.filter(pc.equal(table.column("fold"), kind)).combine_chunks()
            held[kind] += own.to_batches()
            size[kind] += own.column("text").nbytes
            if size[kind] >= BATCH_BYTES:
                yield flush(kind)
    for kind in (0, 1):
        if size[kind]:
            yield flush(kind)


def asks_of(narrow: DataFrame, shards: int, turns: int = 1, turn: int = 0, orders: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``batch, shard, n, keys, counts``: what each batch holds of each shard, words first, then pairs.

    Of ``turns`` only the batches whose ``turn`` it is; of words (0) and pairs (1) those of ``orders``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in batches_of(batches, TaskContext.get().partitionId()):
            if (number >> 1) % turns != turn:
                continue
            token, before, sizes = tokens_of(table.column("text").combine_chunks())
            learned = np.repeat(~np.asarray(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool), sizes)
            rows, keys = [], keys_of(token, before)
            for order in orders:
                own, counts = different(keys[order], learned)
                bounds = _cut_up(own, shards)
                for i in range(shards):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b:
                        steps = np.diff(own[a:b], prepend=np.uint64(0))
                        rows.append((number, order * shards + i, b - a, pack_numbers(steps), pack_numbers(counts[a:b])))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                ["batch", "shard", "n", "keys", "counts"],
            )

    return narrow.mapInArrow(run, "batch long, shard int, n long, keys binary, counts binary")


def _answers(asks: DataFrame, shards: int) -> DataFrame:
    """``batch, shard, n, mark, totals``: for each ask the counts over all batches.

    ``mark`` is the sum of the keys that were asked for. Batch -1 has a shard's
    different learned keys in ``n`` and their occurrences in ``mark``.
    """

    def run(table: pa.Table) -> pa.Table:
        numbers = table.column("batch").to_pylist()
        sizes = table.column("n").to_pylist()
        at = np.cumsum([0, *sizes])
        # A group's numbers are many: each array goes as soon as it has been read.
        flat, marks = np.empty(at[-1], np.uint64), []
        for i, k in enumerate(table.column("keys")):
            np.cumsum(unpack_numbers(k.as_py(), sizes[i]), out=flat[at[i] : at[i + 1]])
            marks.append(int(flat[at[i] : at[i + 1]].sum(dtype=np.uint64).astype(np.int64)))
        order = np.argsort(flat)
        flat = flat[order]
        first = np.concatenate(([True], flat[1:] != flat[:-1]))
        del flat
        counts = np.empty(at[-1], np.int64)
        for i, c in enumerate(table.column("counts")):
            counts[at[i] : at[i + 1]] = unpack_numbers(c.as_py(), sizes[i])
        counts = counts[order]
        totals = np.add.reduceat(counts, np.flatnonzero(first))
        # The counts' room serves for what each ask gets back, in order of the asks.
        counts[order] = totals[np.cumsum(first) - 1]
        back = counts
        del order, first
        shard = table.column("shard")[0].as_py()
        return pa.table(
            [
                pa.array([*numbers, -1], pa.int64()),
                pa.array([shard] * (len(numbers) + 1), pa.int32()),
                pa.array([*sizes, int((totals > 0).sum())], pa.int64()),
                pa.array([*marks, int(totals.sum())], pa.int64()),
                pa.array([*[pack_numbers(back[at[i] : at[i + 1]]) for i in range(len(numbers))], b""], pa.binary()),
            ],
            ["batch", "shard", "n", "mark", "totals"],
        )

    schema = "batch long, shard int, n long, mark long, totals binary"
    return asks.groupBy("shard").applyInArrow(run, schema)


def _cut_up(keys: np.ndarray, shards: int) -> list[int]:
    """Where each of ``shards`` equal ranges of names begins in sorted keys, and the end."""
    return np.searchsorted(keys, np.array([(i << 63) // shards for i in range(shards)], np.uint64)).tolist() + [len(keys)]


def _by_way_of_ranges(asks: DataFrame, ranges: int, shards: int, blocks: int) -> DataFrame:
    """``batch, shard, n, mark, totals`` as ``_answers`` gives, where asks name ranges of shards.

    ``ranges`` times ``ranges`` are the shards of each order. Batches are gathered into blocks,
    about as many to a block as there are ranges, so that the asks of a block to
    one range are about as much as one batch. They are merged, and only the merged keys go
    on to the range's shards, which never see a batch. The answers to a block are then
    given out among its batches, by places in the merged keys. So rows are as many as
    batches times ranges, and no group grows with the corpus.
    """
    block = F.pmod(F.xxhash64("batch"), F.lit(blocks)).alias("block")
    named = asks.select(block, F.col("shard").alias("range"), "batch", "n", "keys", "counts")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["block", "range", "shard", "batch", "n", "mark", "keys", "counts"]

    def merge(table: pa.Table) -> pa.Table:
        own_block, own_range = table.column("block")[0].as_py(), table.column("range")[0].as_py()
        sizes = table.column("n").to_pylist()
        keys = [np.cumsum(unpack_numbers(k.as_py(), n), dtype=np.uint64) for k, n in zip(table.column("keys"), sizes)]
        counts = np.concatenate([unpack_numbers(c.as_py(), n) for c, n in zip(table.column("counts"), sizes)]).astype(np.int64)
        merged, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=counts, minlength=len(merged)).astype(np.int64)
        order, low = divmod(own_range, ranges)
        edges = [((low * ranges + i) << 63) // shards for i in range(ranges)]
        cuts = np.searchsorted(merged, np.array(edges, np.uint64)).tolist() + [len(merged)]
        cuts[0] = 0
        rows = []
        for i in range(ranges):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                rows.append((own_block, own_range, order * shards + low * ranges + i, None, b - a, None,
                             pack_numbers(np.diff(merged[a:b], prepend=np.uint64(0))), pack_numbers(sums[a:b])))
        at = np.cumsum([0, *sizes])
        for i, (batch, n) in enumerate(zip(table.column("batch").to_pylist(), sizes)):
            mark = int(keys[i].sum(dtype=np.uint64).astype(np.int64))
            rows.append((own_block, own_range, None, batch, n, mark, pack_numbers(np.diff(back[at[i] : at[i + 1]], prepend=0)), None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "block long, range int, shard int, batch long, n long, mark long, keys binary, counts binary"
    merged = cut(named.groupBy("block", "range").applyInArrow(merge, schema))
    upper = merged.filter("shard IS NOT NULL").select(F.col("block").alias("batch"), "shard", "n", "keys", "counts")
    told = cut(_answers(upper, shards))

    def spread(asked: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(told.column("shard")))
        parts = [unpack_numbers(told.column("totals")[int(i)].as_py(), told.column("n")[int(i)].as_py()) for i in order]
        totals = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        rows = []
        for batch, range_, n, mark, places in zip(*(asked.column(c).to_pylist() for c in ("batch", "range", "n", "mark", "keys"))):
            at = np.cumsum(unpack_numbers(places, n), dtype=np.uint64).view(np.int64)
            rows.append((batch, range_, n, mark, pack_numbers(totals[at])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["batch", "shard", "n", "mark", "totals"])

    asked = merged.filter("shard IS NULL").select("block", "range", "batch", "n", "mark", "keys")
    to_range = (F.floor(F.col("shard") / shards) * ranges + F.floor(F.col("shard") % shards / ranges)).cast("int").alias("range")
    replies = told.filter("batch >= 0").select(F.col("batch").alias("block"), to_range, "shard", "n", "totals")
    keys = ["block", "range"]
    given = asked.groupBy(*keys).cogroup(replies.groupBy(*keys)).applyInArrow(spread, "batch long, shard int, n long, mark long, totals binary")
    return given.unionByName(told.filter("batch < 0"))


class Batch:
    """Tokens of one batch with the corpus counts of each."""

    def __init__(self, docs: pa.Table, answers: pa.Table, shards: int):
        self.token, before, self.sizes = tokens_of(docs.column("text").combine_chunks())
        keys = keys_of(self.token, before)
        got: list[dict[int, tuple]] = [{}, {}]
        for shard, n, mark, totals in zip(*(answers.column(c).to_pylist() for c in ("shard", "n", "mark", "totals"))):
            got[shard // shards][shard % shards] = (n, mark, totals)
        self.index, self.known, counts = [], [], []
        for order in (0, 1):
            own, _ = different(keys[order])
            parts = [got[order][s] for s in sorted(got[order])]
            mark = sum(p[1] for p in parts) & ((1 << 64) - 1)
            if sum(p[0] for p in parts) != len(own) or mark != int(own.sum(dtype=np.uint64)):
                raise RuntimeError("the input gave other batches when it was read again; write it to a table first")
            self.known.append(np.concatenate([unpack_numbers(p[2], p[0]) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64))
            self.index.append(np.searchsorted(own, keys[order]))
            counts.append(self.known[order][self.index[order]])
        self.word, self.pair = counts
        # The context of a text's first word is the end of the text before it.
        place = np.arange(len(self.token)) - 1
        heads = np.cumsum(self.sizes) - self.sizes
        place[heads] = heads + self.sizes - 1
        self.before = place
        self.context = self.word[place]

    def deleted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pair, context and word counts without the token's own document, and its size."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        less = []
        for index in self.index:
            _, back, n = np.unique(doc * (int(index.max()) + 1) + index, return_inverse=True, return_counts=True)
            less.append(n[back])
        return self.pair - less[1], self.context - less[0][self.before], self.word - less[0], self.sizes[doc]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: twice per doubling of its count."""
    return np.ceil(2 * np.log2(context + 1.0)).astype(np.int64)


def parts_of(pair, context, word, total: int, types: int) -> np.ndarray:
    """The three estimates of each token's probability: pair, word, anything."""
    return np.stack(
        [
            np.where(context > 0, pair / np.maximum(context, 1), 0.0),
            word / np.maximum(total, 1),
            np.full(len(word), 1.0 / (types + 1)),
        ]
    )


def learn_weights(cells: list[tuple]) -> np.ndarray:
    """Mixture weights per bucket by expectation-maximisation, from ``bucket, n, pair, word, any``.

    Each cell stands for n held-out tokens with these mean estimates. A bucket
    starts from the weights of all tokens and stays there if it has no token.
    """
    table = np.array(cells, float).reshape(-1, 5)

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(ROUNDS):
            joint = rows[:, 2:] * weights
            each = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            new = (each * rows[:, 1:2]).sum(axis=0) / rows[:, 1].sum()
            if np.abs(new - weights).max() < 1e-9:
                return new
            weights = new
        return weights

    start = np.full(3, 1 / 3)
    every = fit(table, start) if len(table) else start
    floor = lambda w: (w + 1e-6) / (w + 1e-6).sum()
    out = np.tile(floor(every), (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = table[table[:, 0] == b] if len(table) else table
        if len(rows):
            out[b] = floor(fit(rows, floor(every)))
    return out


def _narrow(docs: DataFrame, id_col: str, text: str, held_out: Column) -> DataFrame:
    number = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    fold = (~held_out & (F.floor(number / 7) % HELD_OUT_FOLDS == 0)).cast("int")
    return docs.select(
        F.col(id_col).alias("id"), held_out.alias("held_out"), fold.alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def _with_batch(narrow: DataFrame, kind: str, only_held_out: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in batches_of(batches, TaskContext.get().partitionId()):
            if number & 1 or not only_held_out:
                for part in table.select(["id", "held_out", "text"]).to_batches(max_chunksize=500):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, number, np.int64)), *part.columns], ["batch", "id", "held_out", "text"]
                    )

    return narrow.mapInArrow(run, f"batch long, id {kind}, held_out boolean, text string")


def scored_only(id_col: str) -> Column:
    """Documents nothing is learned from: CRC-32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(
    docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A word's probability after another mixes the maximum-likelihood estimates of
    the pair and of the word with an even share for every known word and one
    unknown. The weights hang on how frequent the first word is. They are learned
    on one training document in eight, with its own counts deleted from those of
    the corpus; only the table of estimates by bucket and cell, which is of bounded
    size, comes to the driver for that.

    ``held_out`` rows (by default ``scored_only``) are scored but not learned from.
    NULL and empty texts have one token, the end; long ones are scored whole. Ids and
    rows may repeat or be NULL, an empty table gives an empty one, and other
    columns are ignored whatever their names. The input is read three times and has to give the same
    rows in the same partitions, as tables do; if it does not, the job fails.
    """
    kind = dict(docs.dtypes)[id_col]
    narrow = _narrow(docs, id_col, text, scored_only(id_col) if held_out is None else held_out)
    size = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = int(max(8, -(-size // SHARD_BYTES)))
    counted = shards  # shards of either order that the counts are kept in
    if shards <= DIRECT_SHARDS:
        answers = cut(_answers(asks_of(narrow, shards), shards))
    else:
        shards = math.isqrt(shards - 1) + 1  # what batches ask is a range of so many shards
        counted = shards * shards
        blocks = max(1, int(size // (BATCH_BYTES * shards)))
        answers = cut(_by_way_of_ranges(asks_of(narrow, shards), shards, counted, blocks))
    stats = {
        r["words"]: (r["types"], r["total"])
        for r in answers.filter("batch = -1")
        .groupBy((F.col("shard") < counted).alias("words"))
        .agg(F.sum("n").alias("types"), F.sum("mark").alias("total"))
        .collect()
    }
    types, total = stats.get(True, (0, 0))
    replies = answers.filter("batch >= 0")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in _CELL_TYPES], _CELL_NAMES)
        pair, context, word, own = Batch(left, right, shards).deleted()
        estimates = parts_of(pair, context, word, total - own, types)
        grid = [np.where(p > 0, np.round(-STEP * np.log2(np.maximum(p, 1e-30))) + 1, 0).astype(np.int64) for p in estimates[:2]]
        cell = (bucket_of(context) << 40) | (grid[0] << 20) | grid[1]
        names, back, n = np.unique(cell, return_inverse=True, return_counts=True)
        sums = [np.bincount(back, weights=p) for p in estimates]
        return pa.table([pa.array(names), pa.array(names >> 40), pa.array(n), *[pa.array(s) for s in sums]], _CELL_NAMES)

    held = _with_batch(narrow, kind, True).groupBy("batch").cogroup(replies.filter("batch % 2 = 1").groupBy("batch"))
    table = (
        held.applyInArrow(cells, "cell long, bucket long, n long, pair double, word double, any double")
        .groupBy("cell", "bucket")
        .agg(*[F.sum(c).alias(c) for c in ("n", "pair", "word", "any")])
        .select("bucket", "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("pair", "word", "any")])
    )
    weights = learn_weights([tuple(r) for r in table.orderBy("cell").collect()] if total else [])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left, right, shards)
        estimates = parts_of(batch.pair, batch.context, batch.word, total, types)
        mixed = (weights[bucket_of(batch.context)].T * estimates).sum(axis=0)
        base = np.log10((batch.word + 1.0) / (total + types + 1.0))
        n = left.num_rows
        return pa.table(
            [
                left.column("id"),
                left.column("held_out"),
                pa.array(batch.sizes),
                pa.array(sums_by((batch.word > 0).astype(np.int64), batch.sizes)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(sums_by(base, batch.sizes)),
                pa.array(sums_by(np.log10(mixed), batch.sizes)),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = _with_batch(narrow, kind, False).groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_col)


_CELL_NAMES = ["cell", "bucket", "n", "pair", "word", "any"]
_CELL_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
