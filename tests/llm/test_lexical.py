"""Ranked lexical search: scan and ranks against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa

from strayline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    """``item_id, rank, doc_id, score`` of (id, text) lists."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    all_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        rows = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * all_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c
            )
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, i, **more).collect()), key=str)


def test_scan_counts_whole_terms_only():
    items = lexical.Items.of([1, 2], ["A cat, a CAT; über", "cats über-9"], pa.int64())
    assert items.terms == sorted(["a", "cat", "über", "cats", "9"], key=str)
    texts = [None, "", "cat cat a a a", "cats concat cat_cat\x00über", "ÜBER über. Über", "x" * 3_000_000 + " cat " * 10]
    found = list(lexical.occurrences(pa.array(texts, pa.string()), items.automaton()))
    for text, (n, which, often) in zip(texts, found):
        every = terms(text)
        assert n == len(every)
        assert {items.terms[w]: f for w, f in zip(which, often)} == {t: c for t, c in Counter(every).items() if t in items.terms}


def test_ranks_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert got(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_and_cells_give_the_same(spark, monkeypatch):
    docs = [(k, f"w{k % 7} w{k % 3} common " * (1 + k % 5)) for k in range(200)]
    items = [(k, f"W{k} common, w{k + 1}") for k in range(9)]
    want = brute(docs, items)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lexical, "CELLS", 8)
    assert got(spark, docs, items) == want


def test_odd_rows_ties_and_clashes(spark, odd_docs, no_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    asked = [(1, "LOREM one"), (1, "dolor"), (1, "LOREM one"), (2, None), (3, ""), (None, "id here"), (4, "café hex -- ..."), (5, "absent")]
    items = spark.createDataFrame([(*a, "x", 1) for a in asked], "item_id long, text string, term string, score int")
    rows = sorted((tuple(r) for r in lexical.search(odd_docs, items).collect()), key=str)
    assert rows == brute(pairs, asked)
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(odd_docs, items.limit(0)).count() == 0
    ties = [(k, "same words here") for k in range(30, 0, -1)] + [(7, "same words here"), (50, "other")]
    assert got(spark, ties, [(1, "same")]) == brute(ties, [(1, "same")])
