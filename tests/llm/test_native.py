"""Sharding, mixing, exact copies and secrets against brute force."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strayline.llm import exact, mixing, secrets, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(name, request):
    return request.getfixturevalue(name)


TABLES = ["docs", "odd_docs", "no_docs"]


@pytest.mark.parametrize("table", TABLES)
def test_sharding(request, table):
    df = both(table, request)
    rows, given = sharding.shard_documents(df).collect(), df.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(spark, n):
    placed = sharding.permuted(spark.range(n), "id", n, "p", seed=9).orderBy("id").collect()
    assert sorted(r.p for r in placed) == list(range(n))
    again = sharding.permuted(spark.range(n).repartition(3), "id", n, "p", seed=9).orderBy("id").collect()
    assert placed == again
    if n >= 1000:
        assert sum(r.id == r.p for r in placed) < 20


def sources_by_hand(sizes):
    """Stop the sources that are above their most, one round after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, stopped, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] >= 3 * sizes[s]}
        for s in over:
            target[s] = 3.0 * sizes[s]
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("table", TABLES)
def test_mixing(request, table):
    df = both(table, request)
    rows, given = mixing.mixed_documents(df).collect(), df.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in given:
        sizes[r.source] += count(r.text)
    target = sources_by_hand(sizes) if sizes else {}
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in rows)
    assert got == Counter((r.doc_id, count(r.text), sizes[r.source], round(target[r.source], 6)) for r in given)
    for r in rows:
        rate = r.target / r.source_size if r.source_size else 0
        low = r["size"] * int(rate)
        assert r.taken in (low, low + r["size"]) and r.taken <= 3 * r["size"]
    emitted = mixing.emit_mix(df)
    assert emitted.columns == df.columns
    assert sum(count(r.text) for r in emitted.collect()) == sum(r.taken for r in rows)


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(20000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"),
    )
    rows = mixing.mixed_documents(df).join(df, "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")
    )
    for r in rows.collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


@pytest.mark.parametrize("table", TABLES)
def test_exact_groups(request, table):
    df = both(table, request)
    rows, given = exact.exact_groups(df).collect(), df.collect()
    groups = defaultdict(list)
    for r in given:
        groups[r.text or ""].append(r.doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r.doc_id, best[r.text or ""], len(groups[r.text or ""]), sha(r.text or "")) for r in given)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    kept = Counter((r.doc_id, r.text_sha256) for r in rows if r.kept)
    assert kept == Counter((best[t], sha(t)) for t in groups)
    left = exact.drop_exact_copies(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, sha(r.text or "")) for r in left.collect()) == kept


def test_long_texts_that_differ_late(spark):
    a = "ab" * 50000
    texts = [a, a[:-1] + "x", a[:8192], a[:8192] + "é", a, a + a, a[:8192] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in exact.exact_groups(df).collect()}
    assert [rows[i].keep_id for i in range(7)] == [4, 1, 2, 3, 4, 5, 6]


def test_time_is_in_proportion_to_length(spark):
    """Texts of 32 MB, the last of which differ in their last character."""
    long = F.repeat(F.lit("añ b"), 32 << 18)
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(long, F.when(F.col("id") > 1, F.col("id").cast("string")).otherwise("")).alias("text"))
    exact.exact_groups(df.limit(0)).collect()
    start = time.monotonic()
    rows = {r.doc_id: r.keep_id for r in exact.exact_groups(df).collect()}
    took = time.monotonic() - start
    print("4 texts of 40 MB of UTF-8:", took, "s")
    assert rows == {0: 1, 1: 1, 2: 2, 3: 3} and took < 60


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def base_spans(text):
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, pattern, group, least) in enumerate(BASE)
        for m in pattern.finditer(text)
        if len(m[group]) >= least
    ]
    return sorted(found)


def check_secrets(df):
    rows, given = secrets.scan_documents(df).collect(), df.collect()
    assert len(rows) == len(given)
    want = Counter()
    for r in given:
        spans = base_spans(r.text or "")
        n = Counter(s[3] for s in spans)
        digest = hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()
        want[(r.doc_id, n["assign"], n["access"], n["hex"], digest)] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    order = ["assign", "access", "hex", "opaque"]
    for r in rows:
        listed = [s for s in r.spans.split(",") if s and not s.startswith("opaque")]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256
        places = [(int(s.split(":")[1]), order.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert places == sorted(places)
    return rows


@pytest.mark.parametrize("table", TABLES)
def test_secrets(request, table):
    check_secrets(both(table, request))


def test_ownership_of_secrets(spark):
    live, copied = "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8"
    rows = [(i, f"see {copied} there", f"s{i}") for i in range(12)]
    rows += [(100, f"é {live}", "s1"), (101, "token: secret = abcdefghij token=x", "s1"), (102, None, None)]
    rows += [(103, f"😀 PASSWORD='{copied}' AKIA" + "A" * 12 + " " + "a1" * 16, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in check_secrets(df)}
    assert found[100].spans == "opaque:2:26" and found[100].n_live == 1
    assert all(found[i].spans == "" for i in range(12))
    assert found[103].n_copied == 1 and found[103].n_live == 2


def test_an_owner_may_hold_a_secret_in_many_documents(spark):
    own, spread = "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "Mm1Nn2Bb3Vv4Cc5Xx6Zz7Ll8"
    rows = [(i, f"file {i} has {own}", "s1") for i in range(9)]  # nine different texts of one owner
    rows += [(20 + i, f"the same text with {spread}", "s2") for i in range(9)]  # nine copies of one text
    rows += [(40 + i, f"file {i} again {own}", "s3") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan_documents(df).collect()
    assert all(r.spans.startswith("opaque:") and r.n_live == 1 for r in found)
    more = df.union(spark.createDataFrame([(60, f"third owner {own}", "s4")], df.schema))
    gone = {r.doc_id: r.spans for r in secrets.scan_documents(more).collect()}
    assert not any(gone[i] for i in (*range(9), 40, 60)) and all(gone[20 + i] for i in range(9))
    owned = secrets.ownership(df.selectExpr("left(text, 4) AS print", "source AS owner", "sha2(text, 256) AS repository")).collect()
    assert {r.print: (r.owners, r.repositories) for r in owned} == {"file": (2, 11), "the ": (1, 1)}


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def xx64(value, seed=42):
    """Spark's xxhash64 of one 64-bit number, by the published algorithm."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    mask, rot = (1 << 64) - 1, lambda x, r: ((x << r) | (x >> (64 - r))) & ((1 << 64) - 1)
    h = (seed + p5 + 8) & mask
    h ^= (rot((value & mask) * p2 & mask, 31) * p1) & mask
    h = (rot(h, 27) * p1 + p4) & mask
    for shift, p in ((33, p2), (29, p3), (32, 1)):
        h = ((h ^ (h >> shift)) * p) & mask
    return h


def xx32(value, seed=42):
    """The same of one 32-bit number."""
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    mask, rot = (1 << 64) - 1, lambda x, r: ((x << r) | (x >> (64 - r))) & ((1 << 64) - 1)
    h = (seed + p5 + 4) & mask
    h ^= ((value & 0xFFFFFFFF) * p1) & mask
    h = (rot(h, 23) * p2 + p3) & mask
    for shift, p in ((33, p2), (29, p3), (32, 1)):
        h = ((h ^ (h >> shift)) * p) & mask
    return h


def place_by_hand(number, n, seed):
    """Six rounds of the network, again and again until the place is below n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    at = number
    while True:
        left, right = divmod(at, b)
        for step in range(sharding.ROUNDS):
            key = xx32(seed * sharding.ROUNDS + step)
            if step % 2 == 0:
                left = (left + signed(xx64(right, key)) % a) % a
            else:
                right = (right + signed(xx64(left, key)) % b) % b
        at = left * b + right
        if at < n:
            return at


@pytest.mark.parametrize("n, seed", [(1, 0), (7, 0), (97, 3), (1000, 0)])
def test_permutation_by_hand(spark, n, seed):
    got = {r.id: r.p for r in sharding.permuted(spark.range(n), "id", n, "p", seed).collect()}
    assert got == {i: place_by_hand(i, n, seed) for i in range(n)}


def test_shard_and_slot_can_be_computed(docs):
    """From the row's number in the order of ids alone, without the table."""
    rows = sharding.shard_documents(docs).collect()
    n = len(rows)
    for number, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
        place = place_by_hand(number, n, 0)
        assert (r.shard, r.slot) == (place % 16, place // 16)
