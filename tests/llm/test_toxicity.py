"""Toxicity: features and risk by hand, held-out accuracy, odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strayline.llm import toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def parts_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = Counter()
    for term in TERM.findall(lower):
        data = term.encode()
        found[("", data)] += 1
        for n in toxicity.PREFIXES:
            if len(data) > n:
                found[(n, data[:n])] += 1
    return found


def test_features_are_roots_of_counts():
    texts = [None, "", "--- !", "Idiot idiot, IDIOTIC x9 Ünïcode", "b" * 5000 + " " + "ab " * 900_000, "a\x00b\x7fc"] * 2
    got = toxicity.features(pa.array(texts, pa.string()))
    assert got.texts == len(texts)
    for i, text in enumerate(texts):
        want = parts_of(text)
        total = sum(want.values())
        mine = got.value[got.text == i]
        assert sorted(np.round(mine, 5)) == pytest.approx(sorted(toxicity.LENGTH * (n / total) ** 0.5 for n in want.values()), abs=1e-4)
    one = lambda s: set(toxicity.features(pa.array([s])).feature.tolist())
    assert one("idiotic") & one("IDIOTS") and not one("idiot") & one("xyzzy")


def test_risk_and_slope_by_hand():
    rng = np.random.default_rng(3)
    z, toxic, prior = rng.normal(0, 2, 40), np.arange(40) < 13, 0.2
    loss = lambda t: float(np.log1p(np.exp(-t)))
    positive = prior * sum(loss(v) for v in z[toxic]) / 13
    negative = sum(loss(-v) for v in z[~toxic]) / 27 - prior * sum(loss(-v) for v in z[toxic]) / 13
    assert toxicity.risk(z, toxic, prior) == pytest.approx((positive, negative))
    for shift in (0.0, -30.0):  # far down, the second risk is near 0 but stays above or below it
        at = z + shift
        back = toxicity.risk(at, toxic, prior)[1] < 0
        value = lambda v: -toxicity.risk(v, toxic, prior)[1] if back else sum(toxicity.risk(v, toxic, prior))
        numeric = [(value(at + 1e-5 * np.eye(40)[k]) - value(at - 1e-5 * np.eye(40)[k])) / 2e-5 for k in range(40)]
        assert toxicity.slope(at, toxic, prior) == pytest.approx(numeric, abs=1e-6)
    confident = np.where(toxic, 9.0, -9.0)  # more toxic risk taken away than there is
    assert toxicity.risk(confident, toxic, prior)[1] < 0
    assert (toxicity.slope(confident, toxic, prior)[toxic] > 0).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count()
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    bad, good = ([r.score for r in tested if truth[r.doc_id] == k] for k in (1, 0))
    auc = np.mean([(np.array(good) < b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])
    caught, wrong = np.mean([b >= 0.5 for b in bad]), np.mean([g >= 0.5 for g in good])
    print("held-out area", auc, "caught", caught, "wrong", wrong, "prior", model.prior)
    assert auc > 0.97 and caught > 0.8 and wrong < 0.01


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, other = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), turned)
    assert one.prior == other.prior
    # Another order of the same rows changes the last bits of sums only.
    assert np.abs(one.weights - other.weights).max() < 1e-3


def test_odd_rows_and_unknown_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 0), (9, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    for given in (none, labels):
        model = toxicity.learn(odd_docs, given)
        rows = toxicity.scored(odd_docs, model).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3, 8)}) == 1
        if given is none:
            assert {r.score for r in rows} == {0.0}
        assert toxicity.scored(no_docs, model).count() == 0
    assert toxicity.learn(no_docs, labels).weights is None
