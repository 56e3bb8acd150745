"""Token alignment: groups, links and counts against plain Python."""

from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from strayline.llm import alignment

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@cache
def byte_of(letter):
    """The byte a letter of the vocabulary stands for, counted off."""
    prints = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    hidden = [b for b in range(256) if b not in prints]
    return hidden[ord(letter) - 256] if ord(letter) >= 256 else ord(letter)


def brute(texts):
    """A row per text, with no help from the module."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    left.encode_special_tokens = True
    rows, links = [], []
    for text in texts:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spell_a = [bytes(map(byte_of, left.id_to_token(i))) for i in a]
        spell_b = []
        for i in b:
            p = right.id_to_piece(i)
            spell_b.append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        if not text or b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            rows.append([0, 0, 0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(s) for s in spell_a]).tolist(), np.cumsum([len(s) for s in spell_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        group = lambda e: next(k for k, c in enumerate(common) if c >= e)
        sides = [([], []) for _ in common]
        for i, e in zip(a, ends_a):
            sides[group(e)][0].append(i)
        for i, e in zip(b, ends_b):
            sides[group(e)][1].append(i)
        own = Counter((x, y) for p, q in sides for x in p for y in q)
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in sides)
        rows.append([len(a), len(b), len(common), sum(own.values()), 0, 0, sha256(listed.encode()).hexdigest()])
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for row, own in zip(rows, links):
        row[4] = sum(n for p, n in own.items() if count[p] == best[p[0]])
        row[5] = sum(n * count[p] for p, n in own.items())
    return rows


ODD = [
    None,
    "",
    " ",
    "a",
    "Hello  world,\n\n  it's   <|endoftext|> and </s> <s> <unk> <0x41>",
    "naïve café \U0001f600\U0001f468‍\U0001f469 漢字かな",
    "▁under▁ the bar",
    "12345 67890" * 30,
    "=" * 700 + " " * 300 + "-" * 50,
    "é ﬁ  　 ​\r\t\x00\x07",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 20,
    "Hello  world,\n\n  it's   <|endoftext|> and </s> <s> <unk> <0x41>",
]


def rows_of(spark, docs):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.align(docs, *PATHS).collect()
    return {r.doc_id: [r[c] for c in columns] for r in found}, len(found)


@pytest.mark.parametrize("slice_bytes, slice_rows, links", [(1 << 20, 8192, 1 << 22), (300, 2, 50)])
def test_against_brute_force(spark, monkeypatch, slice_bytes, slice_rows, links):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = ODD + [t[:3000] for t in given]
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(alignment, "LINKS", links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, n = rows_of(spark, docs)
    want = brute(texts)
    assert n == len(texts)
    for k, row in enumerate(want):
        assert got[k] == row, texts[k]


def test_both_encoders_give_the_same_ids():
    """Every character of Unicode, alone, doubled, and beside letters, digits and blanks."""
    made = alignment.ByteLevel(PATHS[0])
    assert made.plain is not None
    texts = [f"a{c}b1{c} {c}  {c}9 .{c}.{c}{c}" for c in map(chr, range(1, 0x110000, 3)) if not "\ud800" <= c <= "\udfff"] + [t for t in ODD if t]
    fast = made.encode(texts)
    made.plain = None
    assert fast == made.encode(texts)


def test_groups_by_components():
    """Terminals against components of the overlap graph, found by a plain search."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 400):
        ends = [np.unique(np.append(rng.integers(1, n + 1, max(1, n // k)), n)) for k in (2, 3)]
        got = alignment.last_of_group(*ends)
        common = np.intersect1d(*ends)
        for side, last in zip(ends, got):
            assert np.array_equal(ends[1][last], common[np.searchsorted(common, side)])
    # A chain through the whole text: the two sides meet at its end alone.
    long = 200_000
    a, b = np.append(np.arange(2, long, 4), long), np.append(np.arange(4, long, 4), long)
    last_a, last_b = alignment.last_of_group(a, b)
    assert set(last_a) | set(last_b) == {len(b) - 1}


def test_odd_tables(spark, odd_docs, no_docs):
    got, n = rows_of(spark, odd_docs)
    rows = odd_docs.collect()
    assert n == len(rows)
    assert got[1] == got[2] == got[3] == [0, 0, 0, 0, 0, 0, ""]
    want = brute([r.text for r in rows if len(r.text or "") < 10_000])
    short = [r for r in rows if len(r.text or "") < 10_000]
    for r, w in zip(short, want):
        if r.doc_id in (9, 10):
            assert got[r.doc_id][:4] == w[:4] and got[r.doc_id][6] == w[6]
    assert alignment.align(no_docs, *PATHS).count() == 0
