import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.llm import simhash as s
from floorline.llm.components import components
from floorline.llm.jaccard import keep_one

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "Ünï cØde WORDS here", "a b c d", "a b c d e", "x " * 70_000, "tab\tand\x0bvt\x1cfs nbsp x"])
def test_fingerprint(text):
    assert s.fingerprint(text) == plain_fingerprint(text)


def brute(values, distance):
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def partition(pairs, n):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def made(seed, groups=30, each=12, flips=3):
    rng = np.random.default_rng(seed)
    out = []
    for centre in rng.integers(0, 1 << 63, groups, dtype=np.uint64):
        for _ in range(each):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("bucket, parts, distance", [(1 << 16, 2, 4), (5, 2, 4), (1 << 16, 3, 4), (1 << 16, 2, 2), (3, 2, 2)])
def test_links_equal_brute_force(spark, bucket, parts, distance):
    values = made(bucket % 97 + parts)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in s.link_fingerprints(df, distance=distance, parts=parts, bucket=bucket).collect()]
    assert partition(pairs, len(values)) == brute(values, distance).tolist()


@pytest.mark.parametrize("bucket, parts, distance, batch, chunk", [(5, 2, 4, 1 << 16, 1 << 16), (3, 2, 2, 1 << 16, 8), (5, 2, 4, 4, 2), (8, 3, 4, 7, 4)])
def test_sets_over_the_limit_meet_at_midpoints(spark, monkeypatch, bucket, parts, distance, batch, chunk):
    """All links are found, though sets under a variant pass the limit, in one batch or over many."""
    sent, plain = [], s._midpoints
    monkeypatch.setattr(s, "_CHUNK", chunk)
    monkeypatch.setattr(s, "_midpoints", lambda over, *rest: sent.append(over.groupBy("part", "variant").count().agg(F.min("count"), F.count("*")).first()) or plain(over, *rest))
    values = np.unique(np.concatenate((made(3, groups=12, each=30, flips=2), made(4, groups=40, each=3))))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        pairs = [(at[r.a], at[r.b]) for r in s.link_fingerprints(prints, distance=distance, parts=parts, bucket=bucket).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert partition(pairs, len(values)) == brute(values, distance).tolist()
    assert sent and sent[0][0] > bucket and sent[0][1] > 5  # whole sets, none of them within the limit


def test_large_bucket_is_walked(spark):
    values = made(5, groups=2, each=3000, flips=5)
    assert (np.unique(s._reach(values, 4), return_inverse=True)[1] == np.unique(brute(values, 4), return_inverse=True)[1]).all()


def test_thresholds_and_partitions():
    n, rng = 1000, np.random.default_rng(0)
    bits = rng.integers(0, 2, (n, 64)).astype(np.float64)
    bits[:, 40] = bits[:, 3]  # two bits that always agree share a partition
    groups = s.group_bits(n, bits.T @ bits, 2)
    assert sorted(sum(groups, [])) == list(range(64)) and [len(g) for g in groups] == [32, 32]
    assert any({3, 40} <= set(g) for g in groups)
    flat = np.full(33, 1 / 33)
    steep = np.concatenate(([0.9], np.full(32, 0.1 / 32)))
    for shares in ([flat, flat], [flat, steep], [steep, flat]):
        got = s.allocate(10**6, shares, [32, 32], 4)
        assert sum(t + 1 for t in got) == 5


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, int(x)) for x in range(1001, 1200)] + [(5, 5), (70, 70)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + links[:10], "a long, b long").repartition(4)).collect()}
    nodes = sorted({x for l in links for x in l})
    at = {x: i for i, x in enumerate(nodes)}
    want = partition([(at[a], at[b]) for a, b in links], len(nodes))
    for i, x in enumerate(nodes):
        assert got.get(x, x) == nodes[want[i]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(s, "COPIES", 5)
    rows = [(100 - i, "one text that is there again and again") for i in range(40)] + [(200 + i, f"text {i} of its own kind {i * 7}") for i in range(20)] + [(None, "one text that is there again and again")] * 3
    got = s.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component) for r in got) == sorted((d or -1, 61 if d is None or d <= 100 else d) for d, _ in rows)


def test_edges(spark):
    long_ = "word " * 30_000 + "end"
    rows = [(9, "same text over and over again"), (3, "Same text over and OVER again"), (3, "Same text over and OVER again"), (7, None), (8, ""), (None, "same text over and over again"), (20, long_), (21, long_)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x")).withColumn("component", F.lit(1)).withColumn("a.b", F.lit(2))
    got = sorted(((r.doc_id, r.component) for r in s.near_duplicates(df).collect()), key=str)
    assert got == sorted([(9, 3), (3, 3), (3, 3), (7, 7), (8, 7), (None, 3), (20, 20), (21, 20)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 20, None], key=str)
    empty = spark.createDataFrame([], DOCS)
    assert s.near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0
