"""Block-max search against plain scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from floorline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, QUERIES = "doc_id long, text string, block string, words long", "item_id string, text string, score long"


def low(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs: list[tuple], queries: list[tuple], k: int = 10) -> list[tuple]:
    bags = [(i, Counter(low(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in queries:
        scores = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            score = 0
            for w in low(text):
                if w in bag:
                    m = 25 + 75 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Étude", "straße", "naïve", "The", "the"]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice([0, 1, 3, 20, 200])))) for i in range(n)]


def run(spark, docs, queries, k=10, parts=3):
    table = spark.createDataFrame([(i, t, "b", 1) for i, t in docs], DOCS).repartition(parts)
    return search.search(search.build_index(table), spark.createDataFrame([(i, t, 5) for i, t in queries], QUERIES), k=k)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_all_documents(spark, monkeypatch, seed):
    """Small blocks, rare and frequent terms, repeated terms, repeated queries of one id, null and empty texts."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    docs = [*corpus(seed, 180), (None, "the w1 w2"), (500, None), (5, "w3 w3 The"), (5, "w3 w3 The")]
    queries = [("a", "w1 w7 w7, THE straße"), ("b", "w50 Étude"), ("b", "w3"), ("c", ""), ("d", None), ("e", "unknown words"), (None, "naïve w2")]
    got = [tuple(r) for r in run(spark, docs, queries).collect()]
    assert sorted(got, key=str) == sorted(ranked(docs, queries), key=str)


def test_ties_and_a_term_of_all_documents(spark, monkeypatch):
    """Copies tie by id, over more blocks than one; a term that all documents have still scores, if its weight is above 0."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(100, "same")]
    queries = [("q", "same here"), ("r", "same")]
    got = [tuple(r) for r in run(spark, docs, queries, k=5).collect()]
    assert sorted(got) == sorted(ranked(docs, queries, 5))
    assert [r[2] for r in sorted(got) if r[0] == "q"] == [1, 2, 3, 4, 5]


def test_queries_in_slices(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 12)
    docs, queries = corpus(4, 60), [(str(i), f"w{i} w{i + 1} the") for i in range(9)]
    assert sorted(tuple(r) for r in run(spark, docs, queries).collect()) == sorted(ranked(docs, queries))


def test_empty_tables(spark):
    assert run(spark, [], [("a", "w1")]).collect() == [] and run(spark, [(1, "w1")], []).collect() == []
    assert run(spark, [(1, None), (2, "")], [("a", "w1")]).collect() == []


def blocks_of(docs: list[tuple], size: int, queries: search.Queries) -> list:
    out = []
    for a in range(0, len(docs), size):
        builder = search._Builder()
        for i, t in docs[a : a + size]:
            builder.add(i, t)
        out.append(search._Block(dict(zip(search.BLOCKS.names, builder.row(str(a)), strict=True)), queries))
    return out


def test_bounds_hold_and_blocks_are_left_out():
    """No document passes its block's bound; with a rare term few of the blocks are scored."""
    docs = corpus(9, 400) + [(1000 + i, "zebra zebra w1") for i in range(3)]
    queries = search.Queries.of(["zebra w1", "w2 w3 w40", "the"])
    sizes = [len(low(t)) for _, t in docs]
    queries.docs, queries.words = sum(s > 0 for s in sizes), sum(sizes)
    blocks = blocks_of(docs, 20, queries)
    holders = np.zeros(len(queries.terms), dtype=np.int64)
    for b in blocks:
        at, n = b.holders()
        holders[at] += n
    queries.weights = np.array([search.weight(queries.docs, int(h)) for h in holders])
    for b in blocks:
        bounds = b.bounds()
        assert all(b.scores(q).max() <= bounds[q] for q in range(3))
    best = [[] for _ in range(3)]
    scored = search.search_blocks(blocks, np.zeros(3, dtype=np.int64), 3, best)
    assert scored < 3 * len(blocks) / 2
    assert [d for _, d in best[0]] == [1000, 1001, 1002]


def test_a_block_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 1000)
    docs = [(i, "word " * (1 if i % 2 else 400)) for i in range(10)]
    index = search.build_index(spark.createDataFrame([(i, t, "", 0) for i, t in docs], DOCS).coalesce(1))
    assert index.count() == 10 and index.selectExpr("sum(words)").first()[0] == sum(len(t.split()) for _, t in docs)
