"""Language identification: exact filters by hand, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strayline.llm import language


def by_hand(text):
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    padded = [" ", *letters, " "]
    return [tuple(padded[i - 1 : i + 2]) for i in range(1, len(padded) - 1) if padded[i] != " "]


def test_trigrams():
    texts = [None, "", "a", "Ab1 cÉ\U0001f600", " zß ", "x"] * 3
    keys, counts = language.trigrams(pa.array(texts, pa.string()))
    want = [by_hand(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    number = lambda g: sum((0 if c == " " else ord(c)) << s for c, s in zip(g, (42, 21, 0)))
    assert keys.tolist() == [number(g) for w in want for g in w]


def test_filter_holds_what_it_learned_and_little_else():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**62, 70 * 500).astype(np.uint64)
    owner = np.repeat(np.arange(70), 500)
    made = language.Filter.of([f"l{i:02}" for i in range(70)], owner, keys)
    places = made.places(keys, len(made.masks))
    held = made.masks[places[0]] & made.masks[places[1]] & made.masks[places[2]]
    bits = lambda held, i: (held[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
    other = rng.integers(0, 2**62, 20000).astype(np.uint64)
    p = made.places(other, len(made.masks))
    wrong = made.masks[p[0]] & made.masks[p[1]] & made.masks[p[2]]
    for i in (0, 63, 64, 69):
        assert bits(held, i)[owner == i].all()
        assert abs(bits(wrong, i).mean() - made.false_rates()[i]) < 0.01


def test_held_out_accuracy(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    rows = language.identify(docs, model).collect()
    given = {r.doc_id: r for r in docs.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(list(given))
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in {*model.languages, "und"}
        if r.held_out:
            right.append(r.lang_pred == given[r.doc_id].lang)
    print("held-out accuracy", np.mean(right))
    assert np.mean(right) > 0.97
    odd = language.identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert language.identify(no_docs, language.learn(no_docs)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(no_docs)).collect()} == {"und"}


def test_predictions_by_hand(spark, monkeypatch):
    """Counts, filter, popcounts and verdicts again in plain Python, on few documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = docs.collect()
    counts, total = {}, Counter()
    for r in given:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for gram in by_hand(r.text):
                counts.setdefault(r.lang, Counter())[gram] += 1
                total[r.lang] += 1
    names = sorted(counts)
    known = {l: {g for g, n in counts[l].items() if n >= language.RAREST * total[l]} for l in names}
    number = lambda g: sum((0 if c == " " else ord(c)) << s for c, s in zip(g, (42, 21, 0)))
    rows = 1 << max(6, (language.ROWS_PER_GRAM * max(map(len, known.values())) - 1).bit_length())
    places = lambda g: [int(p[0]) for p in language.Filter.places(np.array([number(g)], np.uint64), rows)]
    masks = [0] * rows
    for bit, l in enumerate(names):
        for gram in known[l]:
            for p in places(gram):
                masks[p] |= 1 << bit
    false = [(sum(m >> bit & 1 for m in masks) / rows) ** language.HASHES for bit in range(len(names))]
    got = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    seen = {}
    for r in given[:60]:
        grams = by_hand(r.text)
        if not grams:
            assert got[r.doc_id].lang_pred == "und"
            continue
        hits = [0] * len(names)
        for gram in grams:
            if gram not in seen:
                held = -1
                for p in places(gram):
                    held &= masks[p]
                seen[gram] = held
            for bit in range(len(names)):
                hits[bit] += seen[gram] >> bit & 1
        scores = [(h - len(grams) * f) / (1 - f) / len(grams) for h, f in zip(hits, false)]
        best = max(range(len(names)), key=lambda b: (scores[b], -b))
        assert got[r.doc_id].lang_pred == names[best] and abs(got[r.doc_id].score - min(max(scores[best], 0), 1)) < 1e-9
