from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from floorline.llm import jaccard as j

DOCS = "doc_id long, text string"


def plain_sets(texts):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def plain_kept(rows):
    """Of each component of pairs with similarity 0.8 or more, the least id."""
    rows = sorted(rows)
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter(rows[i][0] for i in range(len(rows)) if find(i) == i)


def made(seed, groups=25, chain=6):
    """Chains of texts, each changed a little from the one before, so that their ends differ; and texts with a common passage."""
    rng = np.random.default_rng(seed)
    out = []
    passage = [f"w{x}" for x in rng.integers(0, 50, 40)]
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(1, 200)))]
        if g % 3 == 0:
            words += passage
        for _ in range(chain):
            out.append((len(out), " ".join(words)))
            words = list(words)
            for _ in range(int(rng.integers(1, 1 + max(1, len(words) // 40)))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(10**6)}"
    return out


@pytest.mark.parametrize("seed, frequent", [(1, 6), (2, 10**9), (3, 2)])
def test_keeps_what_brute_force_keeps(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(j, "FREQUENT", frequent)
    rows = made(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert Counter(r.doc_id for r in j.keep_one(df).collect()) == plain_kept(rows)


def test_stage_drops_near_copies_that_bits_miss(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    kept = Counter(r.doc_id for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert kept == plain_kept(rows)
    assert 1 in kept and 177 not in kept  # 0.83 similar, 9 bits apart


def test_same_id_with_unrelated_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, b.upper())]
    assert Counter((r.doc_id, r.text) for r in j.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == Counter({(1, a): 1, (1, b): 1})


@pytest.mark.parametrize("batch", [1, 2, 3, 100])
def test_texts_meet_across_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [(k, k ^ n, (10 << 32) + n) for k in range(6) for n in range(k)] + [(5, 5 ^ 2, (10 << 32) + 2)]
        got = Counter((r.key, r.node, r.at & 255) for r in j._meet(spark.createDataFrame(rows, "key long, mixed long, at long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter({(k, n, n): 1 for k in range(2, 6) for n in range(k)})


def test_a_loose_group_lists_few_pairs(spark, monkeypatch):
    """Copies of one text with so many changes that few are as similar as asked: their pairs must not all become rows."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    listed, plain = [], j._similar
    monkeypatch.setattr(j, "_similar", lambda pairs, *more: listed.append(pairs.count()) or plain(pairs, *more))
    got = Counter(r.doc_id for r in j.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == plain_kept(rows) and len(got) > 20
    assert listed[1] < 300 * 299 / 2 / 10


@pytest.mark.parametrize("shared, own, most", [(70, 12, 0), (120, 30, 0)])
def test_a_common_passage_brings_no_pairs(spark, monkeypatch, shared, own, most):
    """Texts that share a passage too short for the similarity lie under its shingles together, and aren't held to each other there."""
    passage = [f"w{x}" for x in range(shared)]
    rows = [(i, " ".join(passage + [f"x{i}y{k}" for k in range(own)])) for i in range(400)]
    met, plain = [], j._sides

    def sides(open_, similarity):
        a, b = plain(open_, similarity)
        met.append(a.join(b, ["key", "band"]).count())
        return a, b

    monkeypatch.setattr(j, "_sides", sides)
    got = Counter(r.doc_id for r in j.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter(range(400)) and met == [most]


def test_sets_of_other_sizes_meet(spark):
    """The smaller set of a pair may lie at the edge of the sizes allowed, and no pair that is similar is lost."""
    rng = np.random.default_rng(8)
    rows, base = [], [f"w{x}" for x in range(104)]
    for n in range(70, 105):  # of 66 to 100 shingles
        for head in (0, 3):
            words = base[:n]
            words[:head] = [f"x{rng.integers(10**6)}" for _ in range(head)]
            rows.append((len(rows), " ".join(words)))
    sets = plain_sets([t for _, t in rows])
    want = {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(rows, DOCS)
    nodes = {r.node: r.doc_id for r in texts.select(j.node("text").alias("node"), "doc_id").collect()}
    given = texts.select(j.node("text").alias("node"), "text")
    met = j._meet(j._file(given, 5, 0.8))
    apart = met.selectExpr("key", "node", "at", "node AS root", "hub AS top")
    got = {tuple(sorted((nodes[r.a], nodes[r.b]), reverse=True)) for r in j._unjoined(apart, j._light(given, met.select("node").distinct(), 5), 0.8).collect()}
    assert want <= got


def test_sketches_lose_no_pair():
    rng, near = np.random.default_rng(0), 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2
        b = np.concatenate((a[: n - int(rng.integers(0, 1 + n // 4))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            near += 1
            assert j.may_be_similar(j.sketch(a), j.sketch(b), len(a), len(b), 0.8)
        differ = int(np.bitwise_count((j.parity(a) ^ j.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            assert len(a) + len(b) - differ >= (len(a) + len(b)) * (1.6 / 1.8) - 1e-6
    assert near > 50
    far = [np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * 2) for _ in range(2)]
    assert not j.may_be_similar(j.sketch(far[0]), j.sketch(far[1]), len(far[0]), len(far[1]), 0.8)


def test_fingerprints_bring_candidates_that_are_checked(spark, monkeypatch):
    """Operator 3's links are among what is compared, and only those similar enough count."""
    from floorline.llm import jaccard, simhash

    base = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, "other words than those above"), (4, "other words than those here")]
    near = spark.createDataFrame(texts, "node long, text string")
    assert [tuple(r) for r in simhash.candidates(near, doc_id="node").collect()] == [(1, 2)]
    asked = []
    real = jaccard._similar
    monkeypatch.setattr(simhash, "candidates", lambda t, **_: t.select(t.node.alias("a")).crossJoin(t.select(t.node.alias("b"))).where("a < b"))
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *more: asked.append(pairs.count()) or real(pairs, *more))
    docs = near.withColumnRenamed("node", "doc_id")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 3, 4] and asked[0] == 6
