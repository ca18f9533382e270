"""Sums of vectors in two phases, against sums one by one."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.operators import vectors

ROWS = "recording_id long, label int, vector array<double>, duration_ms double, total string, n int"


def made(seed: int, n: int, groups: int, width: int = 5):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.35  # a third of the rows in one group
    return [(0 if h else int(rng.integers(0, groups)), int(rng.integers(0, 3)), rng.normal(size=width).tolist() if rng.random() > 0.05 else None, float(rng.integers(1, 9)), "x", 1) for h in hot]


@pytest.mark.parametrize("groups, weight", [(3, None), (3, "duration_ms"), (200, "duration_ms"), (200, None)])
def test_sums_are_those_of_single_vectors(spark, groups, weight):
    rows, want = made(groups, 600, groups), defaultdict(lambda: [0, 0])
    for r, label, v, w, *_ in rows:
        if v is not None:
            want[r, label] = [want[r, label][0] + np.array(v) * (w if weight else 1), want[r, label][1] + 1]
    got = {(x.recording_id, x.label): (x.total, x.n) for x in vectors.vector_sums(spark.createDataFrame(rows, ROWS).repartition(4), ["recording_id", "label"], weight).collect()}
    assert got.keys() == want.keys()
    for key, (total, n) in want.items():
        assert np.allclose(got[key][0], total) and got[key][1] == n


def test_groups_are_passed_on_before_they_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD_GROUPS", 5)
    rows = spark.range(300).select((F.col("id") % 60).alias("recording_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    got = {r.recording_id: (r.total, r.n) for r in vectors.vector_sums(rows.coalesce(1), ["recording_id"]).collect()}
    assert got == {i: ([5.0, float(sum(range(i, 300, 60)))], 5) for i in range(60)}


def test_what_is_shuffled_does_not_depend_on_width(spark):
    """No row for each number: one row a group and task leaves the first phase, for 4 numbers or 400."""
    for width in (4, 400):
        rows = spark.range(0, 1000, 1, 2).select((F.col("id") % 3).alias("recording_id"), F.array_repeat(F.lit(1.0), width).alias("vector"))
        plan = vectors.vector_sums(rows, ["recording_id"])._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "posexplode" not in plan
        assert {(r.recording_id, r.total[0], len(r.total), r.n) for r in vectors.vector_sums(rows, ["recording_id"]).collect()} == {(0, 334.0, width, 334), (1, 333.0, width, 333), (2, 333.0, width, 333)}


def test_empty_table_and_empty_vectors(spark):
    assert vectors.vector_sums(spark.createDataFrame([], ROWS), ["recording_id"]).collect() == []
    got = vectors.vector_sums(spark.createDataFrame([(1, 0, [], 1.0, "", 0), (2, 0, None, 1.0, "", 0)], ROWS), ["recording_id"]).collect()
    assert [(r.recording_id, r.total, r.n) for r in got] == [(1, [], 1)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_running_median(spark, seed):
    from floorline.operators.tally import RunningMedian, running_median

    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=200), rng.integers(0, 3)).tolist()
    median = RunningMedian()
    assert [median.add(x) for x in values] == pytest.approx([float(np.median(values[: i + 1])) for i in range(200)])
    rows = [("a", i, None if i % 9 == 0 else x) for i, x in enumerate(values)] + [(None, 0, 1.0), (None, 1, 4.0), ("b", 5, None)]
    got = {(r.recording_id, r.idx): r.median for r in running_median(spark.createDataFrame(rows, "recording_id string, idx long, level double").repartition(5), "level").collect()}
    plain = lambda n: [x for _, i, x in rows[:200] if i <= n and x is not None]
    assert got == pytest.approx({("a", i): float(np.median(plain(i))) if plain(i) else None for i in range(200)} | {(None, 0): 1.0, (None, 1): 2.5, ("b", 5): None})


def test_cuts_of_a_tree_are_those_of_linkage(spark):
    """At any count or distance the table of merges gives the groups that linkage finds when it stops there."""
    from floorline.operators import cluster
    from floorline.sources.audio import make_voices

    rows, want = [], {}
    cuts = [("one", 1, None), ("three", 3, None), ("all", 99, None), ("near", None, 0.3), ("none", None, -1.0), ("far", None, 5.0)]
    for name, seed in (("a", 3), ("b", 4), ("c", 1)):
        v = np.random.default_rng(seed).normal(size=(1 if seed == 1 else 9 * seed, 6)) + 2 * np.eye(6)[np.arange(1 if seed == 1 else 9 * seed) % 3]
        v = cluster.unit(v)
        rows += [(name, 100 + 7 * i, x.tolist()) for i, x in enumerate(v)]
        for cut, k, threshold in cuts:
            labels = cluster.average_linkage(v, k, threshold)
            first = {l: i for i, l in reversed(list(enumerate(labels.tolist())))}
            want |= {(name, cut, 100 + 7 * i): 100 + 7 * first[l] for i, l in enumerate(labels.tolist())}
    samples = spark.createDataFrame(rows, "recording_id string, idx long, vector array<double>")
    found = cluster.cut_trees(samples, cluster.merge_trees(samples), spark.createDataFrame(cuts, "cut string, k int, threshold double"))
    assert {(r.recording_id, r.cut, r.idx): r.owner for r in found.collect()} == want
    tree = cluster.merge_tree(make_voices(3, 8)[0])
    assert tree.cut(k=3).tolist() == make_voices(3, 8)[1].tolist() and len(tree.height) == 23 and (tree.left < tree.right).all()
