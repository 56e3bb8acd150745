"""Deleted interpolation against counts and weights worked out in plain Python."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strayline.llm import interpolation as lm


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), None]


def by_hand(rows):
    fold = {i: zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) for i, r in enumerate(rows)}
    texts = [split(r.text) for r in rows]
    word, pair = Counter(), Counter()
    for i, t in enumerate(texts):
        if fold[i] % 7 != 2:
            word.update(t)
            pair.update(zip([None, *t], t))
    total, types = sum(word.values()), len(word)
    cells = []
    for i, t in enumerate(texts):
        if fold[i] % 7 != 2 and fold[i] // 7 % 8 == 0:
            own, pairs = Counter(t), Counter(zip([None, *t], t))
            for u, w in zip([None, *t], t):
                c = word[u] - own[u]
                b = math.ceil(2 * math.log2(c + 1))
                cells.append((b, 1, (pair[u, w] - pairs[u, w]) / c if c else 0, (word[w] - own[w]) / (total - len(t)), 1 / (types + 1)))
    weights = lm.learn_weights(cells)
    out = []
    for i, t in enumerate(texts):
        score = base = 0.0
        for u, w in zip([None, *t], t):
            c = word[u]
            l = weights[math.ceil(2 * math.log2(c + 1))]
            score += math.log10(l[0] * (pair[u, w] / c if c else 0) + l[1] * word[w] / max(total, 1) + l[2] / (types + 1))
            base += math.log10((word[w] + 1) / (total + types + 1))
        out.append((rows[i].doc_id, fold[i] % 7 == 2, len(t), sum(word[w] > 0 for w in t), total, base, score))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("table, direct", [("docs", 512), ("docs", 2), ("odd_docs", 512), ("odd_docs", 2), ("no_docs", 512), ("no_docs", 2)])
def test_scores(spark, request, table, direct, monkeypatch):
    """The same scores whether batches ask shards or ranges of shards."""
    monkeypatch.setattr(lm, "BATCH_BYTES", 60_000)
    monkeypatch.setattr(lm, "DIRECT_SHARDS", direct)
    if direct == 2:
        monkeypatch.setattr(lm, "SHARD_BYTES", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id") if table == "docs" else request.getfixturevalue(table)
    rows = docs.collect()
    got, want = order([tuple(r) for r in lm.score_documents(docs).collect()]), order(by_hand(rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < 2e-3 * max(1, abs(w[6]))
    if table == "docs":
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_weights_find_the_mixture():
    rng = np.random.default_rng(3)
    truth = np.array([0.6, 0.3, 0.1])
    dists = rng.dirichlet(np.full(50, 0.3), 3)
    drawn = rng.choice(50, 200_000, p=truth @ dists)
    n = np.bincount(drawn, minlength=50)
    found = lm.learn_weights([(4, n[w], *dists[:, w]) for w in range(50)])
    assert np.abs(found[4] - truth).max() < 0.02 and np.allclose(found.sum(axis=1), 1)


def test_numbers_round_trip():
    x = np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64)
    assert (lm.unpack_numbers(lm.pack_numbers(x), len(x)) == x).all()


def test_no_bucket_is_open_to_the_top():
    counts = np.array([0, 1, 740_000, 10**9, 2**62])
    assert lm.bucket_of(counts).tolist() == [0, 2, 39, 60, 124] and lm.bucket_of(counts).max() < lm.BUCKETS


def test_a_group_holds_few_arrays():
    """Counts over batches, in less than seven arrays as long as the group's keys."""
    class Caught:
        groupBy = lambda self, *_: self
        applyInArrow = lambda self, run, _: run

    random, rows = np.random.default_rng(1), []
    pool = random.integers(0, 1 << 57, 300_000).astype(np.uint64)
    for batch in range(40):
        keys = np.unique(random.choice(pool, 10_000))
        rows.append((batch, 5, len(keys), lm.pack_numbers(np.diff(keys, prepend=np.uint64(0))), lm.pack_numbers(random.integers(0, 3, len(keys)))))
    asks = pa.table([pa.array(c) for c in zip(*rows)], ["batch", "shard", "n", "keys", "counts"])
    tracemalloc.start()
    told = lm._answers(Caught(), 8)(asks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told.num_rows == 41 and peak < 7 * 8 * sum(r[2] for r in rows)
