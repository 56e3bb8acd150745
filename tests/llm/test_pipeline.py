"""Each stage of the pipeline on what its predecessor kept."""

import re
from collections import Counter

import pytest
from test_dartminhash import classes_by_hand, sets_of

import corpus_pipeline
from strayline.llm import kneser_ney, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert name == "packing" or docs.columns == columns
        kept.append(docs.collect())
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good, single, apart, mixed, packed = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in kneser_ney.judged(spark.createDataFrame(given), kneser_ney.trusted_ids(labels)).collect()}
    assert Counter(r.doc_id for r in good) == Counter(i for i, k in verdict.items() if k)
    best = {}
    for r in good:
        best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
    assert Counter(r.doc_id for r in single) == Counter(best.values())
    least = {}
    for r, c in zip(single, classes_by_hand(sets_of([r.text for r in single]))):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert Counter(r.doc_id for r in apart) == Counter(least.values())
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {r.doc_id: r.taken for r in mixing.mixed_documents(spark.createDataFrame(apart)).collect()}
    times = Counter(r.doc_id for r in mixed)
    assert all(times[r.doc_id] * count(r.text) == taken[r.doc_id] for r in apart)
    assert Counter(r.doc_id for r in packed if r.start == 0) == times
    for r in packed:
        assert len(r.ids) == r.length


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert rows.count() > 100


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_documents(spark, request, table, tmp_path):
    docs = request.getfixturevalue(table)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert name == "packing" or docs.columns == columns
    assert (docs.count() > 0) == (table == "odd_docs")
