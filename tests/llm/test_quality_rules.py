"""Counted features against plain Python, sketches against exact quantiles."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strayline.llm import quality_rules as qr
from strayline.llm import tokens


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


ODD = [None, "", "\n\n", "a", "a b c a b c a b", "x\nx\n x\nx\r\n", "é\x85ü |\n\té # <b>", "l\n" * 50, "q w e " * 999, " \x0b\x0c\x1c ", "a\n", "\na\n\na"]


@pytest.mark.parametrize("piece", [40, 1 << 21])
def test_measure(monkeypatch, piece):
    import pyarrow.parquet as pq

    monkeypatch.setattr(qr, "PIECE", piece)
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    got = qr.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = plain(text or "")
        assert {k: got[k][i] for k in want} == want, text


@pytest.mark.parametrize("piece", [64, 1 << 21])
def test_words(monkeypatch, piece):
    texts = ODD + ["z" * 500, "a bc " * 300]
    monkeypatch.setattr(tokens.pieces, "__defaults__", (piece,))
    hashed, counts = tokens.words(pa.array(texts, pa.string()))
    split = [(t or "").encode().split() for t in texts]
    assert counts.tolist() == [len(s) for s in split]
    names = dict(zip([w for s in split for w in s], hashed.tolist()))
    assert [names[w] for s in split for w in s] == hashed.tolist() and len(set(names.values())) == len(names)


def test_slices_depend_on_bytes_alone():
    rows = pa.table({"id": list(range(50)), "text": ["x" * (i % 7) for i in range(50)]})
    for size in (1, 9, 30):
        cut = [[t["id"].to_pylist() for t in tokens.slices(iter(rows.to_batches(max_chunksize=n)), size)] for n in (1, 3, 50)]
        assert cut[0] == cut[1] == cut[2] and sum(cut[0], []) == list(range(50))


def test_judged(spark, odd_docs, no_docs):
    assert qr.judged(no_docs).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (odd_docs, docs):
        rows = qr.judged(df).collect()
        want = Counter()
        for r in df.collect():
            p = plain(r.text or "")
            failed = p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"]
            want[(r.doc_id, *[p[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed)] += 1
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert all(r.kept == (not r.base_failed and r.broken == "") for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    passed = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in passed if labels[r.doc_id] == 1]
    bad = [r.kept for r in passed if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_quartiles_of_sketches(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(1, 10**6, 4000)
    rows = [(int(v), 1000, 0, 0, 0, 1, 0, 0, ("a", "b")[i % 2], None) for i, v in enumerate(values)]
    names = "word_chars n_words n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_marks".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", _language string, _source string")
    merged = qr.sketches(df.repartition(5))
    shares = {"low": F.lit(0.25), "high": F.lit(0.99)}
    found = {r._language: r for r in qr.quantiles(merged.filter("ratio = 'word_length'"), ["_language", "ratio"], shares).collect()}
    for i, name in enumerate("ab"):
        low, high = np.quantile(values[i::2] / 1000, [0.25, 0.99], method="inverted_cdf")
        assert 0.98 <= found[name].low / low <= 1.0 + 1e-9 and 1.0 - 1e-9 <= found[name].high / high <= 1.02


def bucketed(value):
    return math.ceil(math.log(value) / math.log(qr.GROWTH)) if value >= qr.SMALLEST else None


def fences(values, rule):
    """Bounds from a group's values by the rule's quantiles, each value known by its bucket."""
    q, reach, step = rule
    ordered = sorted(values, key=lambda v: -(10**9) if bucketed(v) is None else bucketed(v))

    def at(share, edge, least=0.0):
        b = bucketed(ordered[max(0, math.ceil(round(share * len(ordered), 9)) - 1)])
        return least if b is None else qr.GROWTH**b * edge

    low, middle, high = at(1 - q, 1 / qr.GROWTH), at(0.5, 2 / (1 + qr.GROWTH)), at(q, 1.0, qr.SMALLEST)
    return low - reach * (middle - low) - step, high + reach * (high - middle) + step


def test_verdicts_by_hand(spark, monkeypatch):
    """Which ratios each document breaks, from plain counts and plain quantiles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    own = {r.doc_id: {k: int(v[0]) for k, v in qr.measure(pa.array([r.text], pa.string())).items()} for r in docs}
    part = lambda m, a, b: m[a] / m[b] if m[b] else 0.0
    names = {
        "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"), "capital_share": ("n_capitals", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    }
    ratios = {i: {k: part(m, *ab) for k, ab in names.items()} for i, m in own.items()}
    passed = [r for r in docs if own[r.doc_id]["n_words"] >= 50 and 2 * own[r.doc_id]["n_repeat_words"] <= own[r.doc_id]["n_words"]]
    got = {r.doc_id: r.broken for r in qr.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    broken = Counter()
    for r in passed:
        for k in names:
            group = [p for p in passed if (p.lang, p.source) == (r.lang, r.source)]
            if len(group) < qr.LEAST_DOCUMENTS:
                group = [p for p in passed if p.lang == r.lang]
            if len(group) < qr.LEAST_DOCUMENTS:
                group = passed
            low, high = _cached(fences, k, tuple(p.doc_id for p in group), ratios)
            value = ratios[r.doc_id][k]
            out = value > high or k == "word_length" and value < low
            assert out == (k in got[r.doc_id].split(",")), (r.doc_id, k, value, low, high)
            broken[k] += out
    print(broken)
    assert broken["symbol_share"] > 20 and sum(broken.values()) < 0.2 * len(passed)


_HELD = {}


def _cached(function, k, ids, ratios):
    if (k, ids) not in _HELD:
        _HELD[k, ids] = function([ratios[i][k] for i in ids], qr.RULES[k])
    return _HELD[k, ids]


def test_thresholds_follow_their_group(spark):
    """The same text is junk among clean ones and common among its like."""
    clean = " ".join(f"word{i}" for i in range(90)) + " "
    marked = clean.replace(" ", " # ")
    rows = [(i, clean + f"x{i}", "en", "a") for i in range(200)] + [(900, marked, "en", "a")]
    rows += [(1000 + i, marked + f"x{i}", "en", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in qr.judged(df).collect()}
    assert all(found[i].broken == "" for i in [*range(200), *range(1000, 1200)])
    assert "symbol_share" in found[900].broken
