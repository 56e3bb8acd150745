"""Topics: batches of documents, and the online model against its formulas one document at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.operators import clustering, topics


def texts(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(12)], 30)) + f" own{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


def test_what_is_known_of_a_word_goes_to_a_batch_once(spark):
    counts = cut(topics.word_counts(texts(spark).unionAll(texts(spark)), "id", "text"))
    batches = topics.batches_of(topics.by_document(counts), cut, 200)
    assert 2 < batches.number < 15
    listed = batches.docs.select("_batch", "doc", F.inline(F.arrays_zip("at", "n"))).join(batches.words, ["_batch", "at"])
    assert {tuple(r) for r in listed.select("doc", "word", "n").collect()} == {tuple(r) for r in counts.collect()}
    lists = batches.words.groupBy("_batch").agg(F.count("word").alias("n"), F.countDistinct("word").alias("d"), F.max("at").alias("last")).collect()
    assert all(r.n == r.d == r["last"] + 1 for r in lists)
    assert batches.words.count() < counts.count() / 2


def test_words_of_a_document_lie_together(spark):
    found = topics.word_counts(texts(spark).unionAll(texts(spark)), "id", "text").select("doc", F.spark_partition_id().alias("p"))
    assert found.groupBy("doc").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0


def test_digamma():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 3.7, 8.0, 500.0])
    assert topics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-11)
    assert topics.digamma(np.array([0.5]))[0] == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-11)
    assert topics.digamma(x + 1) - topics.digamma(x) == pytest.approx(1 / x, rel=1e-9)
    assert topics.digamma(np.array([1.0]), 1)[0] == pytest.approx(math.pi**2 / 6, abs=1e-10)
    assert topics.digamma(x, 1) - topics.digamma(x + 1, 1) == pytest.approx(1 / x**2, rel=1e-7)


def test_documents_are_inferred_as_one_by_one():
    rng = np.random.default_rng(7)
    words, alpha, lengths = rng.random((40, 3)), np.array([0.2, 0.4, 0.1]), [5, 1, 30, 12]
    at = np.concatenate([rng.choice(40, m, replace=False) for m in lengths])
    n, gamma = rng.integers(1, 9, len(at)).astype(float), rng.gamma(100, 0.01, (4, 3))
    starts = np.cumsum([0, *lengths[:-1]])
    found, shares, ratios = topics.infer(at, n, starts, words, alpha, gamma)
    expected = lambda g: topics.digamma(g) - topics.digamma(g.sum())
    for d, (first, m) in enumerate(zip(starts, lengths)):
        own, counts, g, change = words[at[first : first + m]], n[first : first + m], gamma[d], 1.0
        theta = np.exp(expected(g))
        norm = own @ theta + 1e-100
        while change > 1e-3:
            last, g = g, theta * (own.T @ (counts / norm)) + alpha
            theta = np.exp(expected(g))
            norm = own @ theta + 1e-100
            change = np.abs(g - last).sum() / 3
        assert found[d] == pytest.approx(g) and shares[d] == pytest.approx(theta)
        assert ratios[first : first + m] == pytest.approx(counts / norm)


def test_rows_keep_their_place_and_few_words_are_kept_if_asked(spark):
    df = spark.createDataFrame([("a a a b",), ("a a a b",), ("",), ("c",)], "text string")
    every = [tuple(r) for r in clustering.topics(df, "text", k=2, max_iter=3).select("text", "topic", "topic_weights").collect()]
    assert sorted(r[0] for r in every) == ["", "a a a b", "a a a b", "c"]
    assert all(t == 0 and w == [0.0, 0.0] if text == "" else sum(w) == pytest.approx(1.0) and w[t] == max(w) for text, t, w in every)
    few = {r.text: r.topic_weights for r in clustering.topics(df, "text", k=2, max_iter=3, vocabulary=1).collect()}
    assert few["c"] == few[""] == [0.0, 0.0] and sum(few["a a a b"]) == pytest.approx(1.0)
