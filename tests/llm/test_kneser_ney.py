"""Modified Kneser-Ney against a plain implementation, verdicts against labels."""

import math
from collections import Counter

import pytest

from strayline.llm import kneser_ney as kn


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), None]


class Plain:
    def __init__(self, texts):
        self.pair = Counter(p for t in texts for p in zip([None, *split(t)], split(t)))
        self.cont = Counter(w for _, w in self.pair)
        self.of = {}
        for (u, w), n in self.pair.items():
            self.of.setdefault(u, []).append(n)
        some = lambda counts: kn.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])
        self.d, self.e = some(self.pair.values()), some(self.cont.values())
        left = sum(self.e[min(c, 3) - 1] for c in self.cont.values())
        self.any = (left if self.cont else 1.0) / max(len(self.pair), 1) / (len(self.cont) + 1)

    def share(self, w):
        c = self.cont[w]
        return (max(c - self.e[min(c, 3) - 1], 0) / len(self.pair) if c else 0) + self.any

    def p(self, u, w):
        own = self.of.get(u)
        if not own:
            return self.share(w)
        c = self.pair[u, w]
        follow = sum(self.d[min(n, 3) - 1] for n in own) / sum(own)
        return (max(c - self.d[min(c, 3) - 1], 0) / sum(own) if c else 0) + follow * self.share(w)

    def score(self, text):
        t = split(text)
        return sum(math.log10(self.p(u, w)) for u, w in zip([None, *t], t))


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_scores(spark, request, table, monkeypatch):
    monkeypatch.setattr(kn, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(kn, "SLICE_BYTES", 200_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if table == "docs" else request.getfixturevalue(table)
    trusted = docs.filter("doc_id % 3 = 1").select("text")
    plain = Plain([r.text for r in trusted.collect()])
    words, gains = kn.train(trusted, "text")
    got = kn.score(docs, words, gains, "doc_id", "text", "lang").collect()
    want = sorted(((r.doc_id or -1, r.lang or "", len(split(r.text)), plain.score(r.text)) for r in docs.collect()))
    assert len(got) == len(want)
    for g, w in zip(sorted((r._id or -1, r._language or "", r.n_tokens, r.score) for r in got), want):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-4 * max(1, abs(w[3]))
    if plain.pair:
        for u in list(plain.of)[:20]:
            assert abs(sum(plain.p(u, w) for w in plain.cont) + plain.p(u, b"\0unknown") - 1) < 1e-9


def test_verdicts(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in kn.judged(docs, kn.trusted_ids(labels)).collect()}
    assert len(rows) == docs.count()
    good = [rows[r.doc_id].kept for r in labels.filter("quality = 1").collect()]
    bad = [rows[r.doc_id].kept for r in labels.filter("quality = 0").collect()]
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.6 * len(bad)
    left = kn.keep_good(docs, kn.trusted_ids(labels))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in rows.items() if r.kept)


def test_odd_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.kept for r in kn.judged(odd_docs, none).collect())
    trusted = odd_docs.select("doc_id").union(spark.createDataFrame([(None,), (77,)], "doc_id long"))
    assert kn.judged(odd_docs, trusted).count() == odd_docs.count()
    assert kn.keep_good(odd_docs, none).count() == odd_docs.count()
    assert kn.judged(no_docs, trusted).count() == 0


def test_discounts():
    assert kn.discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)
    d = kn.discounts([100, 40, 20, 10])
    y = 100 / 180
    assert d == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


def test_bad_documents_are_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = kn.judged(docs, kn.trusted_ids(labels)).join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(bad) < 0.15 * len(bad)


def test_limits_by_language_and_length(spark):
    """Short texts stray by 1, long ones by 0.1; a language with few takes the limits of all."""
    rows = [(l, n, base + w * i / 100) for l, base in (("a", 2.0), ("b", 3.0)) for n, w in ((10, 1.0), (900, 0.1)) for i in range(100)]
    measured = spark.createDataFrame(rows + [("c", 50, 9.0)], "_language string, n_tokens long, log_perplexity double")
    asked = [(l, n, 0.0) for l in ("a", "b", "c", None) for n in (3, 10, 900)]
    limited = kn._limited(spark.createDataFrame(asked, measured.schema), measured)
    got = {(r._language, r.n_tokens): r.threshold for r in limited.collect()}
    assert len(got) == 12
    for l, base in (("a", 2.0), ("b", 3.0)):
        assert got[l, 3] == got[l, 10] == pytest.approx(base + 0.97) and got[l, 900] == pytest.approx(base + 0.097)
    assert got["c", 900] == got[None, 900] < got["c", 10] == got[None, 10]


def test_every_trusted_document_is_trained(spark, monkeypatch):
    """As many as there are, in several passes; none is cut off by number or bytes."""
    monkeypatch.setattr(kn, "PASS_BYTES", 0)
    docs = spark.range(12_600).selectExpr("id AS doc_id", "concat('a', id, ' b ', id % 7) AS text", "'x' AS lang").cache()
    rows = {r.doc_id: r for r in kn.judged(docs, docs.select("doc_id")).collect()}
    taught = {r.doc_id for r in docs.filter(kn.unit("doc_id") < kn.TRAINED_SHARE).collect()}
    assert len(rows) == 12_600 and len(taught) > 10_000
    plain = Plain([f"a{i} b {i % 7}" for i in taught])
    for i in list(range(0, 12_600, 97)):
        assert math.log10(rows[i].perplexity) == pytest.approx(-plain.score(f"a{i} b {i % 7}") / 4, rel=1e-6)
