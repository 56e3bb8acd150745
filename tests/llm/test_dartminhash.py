"""Near copies against brute force over all pairs."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strayline.lineage import scratch_root
from strayline.llm import dartminhash as dm


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def classes_by_hand(sets):
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                shared[own[a], own[b]] += 1
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n >= dm.SIMILAR * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def check(df):
    given = df.collect()
    rows = dm.near_classes(df).collect()
    assert len(rows) == len(given)
    want = defaultdict(list)
    for r, c in zip(given, classes_by_hand(sets_of([r.text for r in given]))):
        want[c].append(r.doc_id)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = Counter((i, least(ids), len(ids)) for ids in want.values() for i in ids)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in rows) == expected
    kept = Counter(r.doc_id for r in rows if r.kept)
    assert kept == Counter(least(ids) for ids in want.values())
    left = dm.drop_near_copies(df)
    assert left.columns == df.columns
    assert Counter(r.doc_id for r in left.collect()) == kept


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    check(no_docs)


def test_a_star_of_edits_and_a_crowd(spark):
    """Copies that are near their origin only, and many texts that share half."""
    random.seed(5)
    draw = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    origin, half = draw(200), draw(100)
    texts = []
    for i in range(60):
        copy = list(origin)
        for at in random.sample(range(10, 190), 4):
            copy[at] = f"e{i}x{at}"
        texts.append(" ".join(copy))
    texts.insert(37, " ".join(origin))
    texts += [" ".join(half + draw(60)) for _ in range(40)]
    texts += [texts[3]] * 30
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(300 * share)
        a, b = np.arange(0, n), np.arange(int(n * 0.3), n)
        w = rng.uniform(0.2, 3.5, 300)
        both = np.concatenate((keys[a], keys[b]))
        owner = np.repeat([0, 1], [len(a), len(b)])
        sizes = np.array([len(a), len(b)])
        name = dm.darts(both, owner, sizes, 2000, np.concatenate((w[a], w[b])))
        assert abs((name[0] == name[1]).mean() - w[b].sum() / w[a].sum()) < 0.05
        plain = dm.darts(both, owner, sizes, 2000)
        assert abs((plain[0] == plain[1]).mean() - len(b) / len(a)) < 0.05


def test_shingles_of_short_texts():
    keys, sizes = dm.shingles(pa.array([None, "", " a ", "a b c d", "a b c d e", "a b c d e f", "x x x x x x x"], pa.string()))
    assert sizes.tolist() == [0, 0, 1, 1, 1, 2, 1] and len(keys) == 6


def test_bitmaps_bound_what_sets_share(spark):
    """Bits that the other map lacks are never more than the shingles the other set lacks."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 400, n).astype(np.uint64) for n in (1, 5, 60, 300, 390)]
    sets = [np.unique(s) for s in sets] + [np.arange(5000, dtype=np.uint64), np.zeros(0, np.uint64)]
    maps = dm.bitmaps(np.concatenate(sets), np.array([len(s) for s in sets])).reshape(len(sets), -1)
    rows = [(i, j, maps[i].tolist(), maps[j].tolist()) for i in range(len(sets)) for j in range(len(sets))]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    lost = {(r.i, r.j): r.lost for r in df.select("i", "j", dm._missing("a", "b").alias("lost")).collect()}
    for (i, j), n in lost.items():
        assert n <= len(np.setdiff1d(sets[i], sets[j]))
    assert lost[2, 6] > 50 and lost[0, 0] == 0


def test_copies_of_origins_that_share_a_part(spark):
    """Two groups whose origins have three quarters in common, and a chain between others."""
    random.seed(8)
    draw = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    part = draw(150)
    texts = []
    for g in range(2):
        origin = part + draw(40)
        for i in range(30):
            copy = list(origin)
            copy[random.randrange(5, 180)] = f"g{g}i{i}"
            texts.append(" ".join(copy))
    chain = draw(120)
    for i in range(8):
        chain = chain[8:] + draw(8)
        texts.append(" ".join(chain))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_every_pair_of_a_bucket_is_met(spark):
    """A crowd in one single bucket, far apart but for a few near pairs."""
    random.seed(11)
    draw = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    core, texts = draw(174), []
    for i in range(240):
        own = draw(26)
        texts.append(" ".join(core + own))
        if i < 80:
            texts.append(" ".join(core + own[:-6] + draw(6)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sketched = dm.cut(dm._sketched(df, "doc_id", "text").withColumn("bands", F.array(F.lit(7).cast("long"))))
    classes = dm.classes_of(df, sketched, "doc_id", "text").join(sketched, F.col("set") == F.col("_row")).collect()
    want, got = classes_by_hand(sets_of(texts)), defaultdict(set)
    for r in classes:
        got[r["class"]].add(r._id)
    by_hand = defaultdict(set)
    for i, c in enumerate(want):
        by_hand[c].add(i)
    assert len(by_hand) == 240
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_hand.values()))


def test_links_are_merged_in_few_tables(spark):
    classes = spark.createDataFrame([(i, i) for i in range(6)], "set long, class long")
    links = spark.createDataFrame([(1, 0), (3, 4)], "x long, y long")
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = len(list(root.iterdir())) if root.exists() else 0
    found = dict(dm.merged(classes, links).select("set", "class").collect())
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    # The links between classes, two for each of two rounds, and the result.
    assert len(list(root.iterdir())) - before <= 6
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "x long, y long")
    assert set(dict(dm.merged(classes, chain).select("set", "class").collect()).values()) == {0}
