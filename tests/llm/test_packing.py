"""Packing: exact round trips, and windows against a search over all cuts."""

import functools
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strayline.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def check(df, rows, exact_ids=True):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) <= 4096
    want = defaultdict(int)
    for r in df.collect():
        ids = encoded(r.text or "") + [2]
        want[(r.doc_id, tuple(ids))] += 1
    left = defaultdict(int)
    for (doc, n), own in docs.items():
        starts = defaultdict(list)
        for r in own:
            starts[r.start].append(r)
        while starts.get(0):
            ids = []
            while len(ids) < n:
                ids += starts[len(ids)].pop(0).ids
            left[(doc, tuple(ids))] += 1
        assert not any(starts.values())
    assert left == want
    return sequences


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 4 = 0")
    sequences = check(df, packing.pack_documents(df.coalesce(1), PATH).collect())
    lengths = [sum(r.length for r in own) for own in sequences.values()]
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding < 0.01 * sum(lengths)


def test_chunks_do_not_show(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    import pyarrow as pa

    table = lambda part: pa.table({"id": [i for i, _ in part], "text": [t for _, t in part]})
    small = [r for own in packing._pieces(iter([table(texts[i : i + 20]) for i in range(0, len(texts), 20)]), PATH, 4096, 0, True) for r in own]
    total = sum(len(encoded(t or "")) + 1 for _, t in texts)
    assert sum(r[2] for r in small) == total and len({r[5] for r in small}) < total / 4000 + 14
    by_doc = defaultdict(list)
    for r in small:
        by_doc[r[0]].append(r)
    for i, t in texts:
        own = sorted(by_doc[i], key=lambda r: r[1])
        assert [x for r in own for x in r[7]] == encoded(t or "") + [2]
        assert {r[4] for r in own} == {len(encoded(t or "")) + 1}


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs, packing.pack_documents(odd_docs, PATH).collect())
    assert packing.pack_documents(no_docs, PATH).count() == 0
    strange = ["a\x1cb <|endoftext|> c", "\x85 x　y", "İstanbul É Σας", "don't 12345 a_b", "x" * 30000, "́a"]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    check(df, packing.pack_documents(df, PATH).collect())


def cost_of(ends, places, cost, capacity):
    extra = dict(zip(places, cost))
    total, lo = 0.0, 0
    for hi in ends[:-1]:
        if hi - lo > capacity:
            return float("inf")
        total += capacity - (hi - lo) + extra[hi]
        lo = hi
    rest = ends[-1] - lo
    return float("inf") if rest > capacity else total + packing.WORD_CUT * (rest.bit_count() - 1)


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_the_best(seed):
    rng = np.random.default_rng(seed)
    places = np.cumsum(rng.integers(1, 9, 11))
    cost = rng.choice([0.0, 8.0, 96.0], 11)
    got = packing.best_windows(places, cost, 16, closed=True)
    inner = places[:-1].tolist()
    ways = [[*c, int(places[-1])] for k in range(len(inner) + 1) for c in itertools.combinations(inner, k)]
    least = min(cost_of(w, places.tolist(), cost.tolist(), 16) for w in ways)
    assert cost_of(got, places.tolist(), cost.tolist(), 16) == least


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["It was. And  then\n\nit's gone!", None, "", "no end", "A. B", "ünï 漢字。 x"]
    assert packing.Encoder(PATH).by_words
    other = public_tokenizers.path("byte_bpe_50k.json")
    made = packing.Encoder(other)
    assert not made.by_words
    ids, counts, stops = made.encode(pa.array(texts, pa.string()))
    want = [Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    ends = np.cumsum(counts)
    assert all(0 < s < ends[-1] and s not in ends and s + 1 not in ends for s in stops.tolist()) and len(stops) >= 2
    # The way by whole texts gives what the way by words gives.
    words = packing.Encoder(PATH)
    one = words.encode(pa.array(texts, pa.string()))
    other = words.encode_whole(pa.array(texts, pa.string()))
    assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()
