import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.operators import cluster as c
from floorline.operators.identity import FarRule, FarStretch, Profile, carry, far_runs, held_final, nearest_profile, replay
from floorline.sources.audio import make_voices

FIXTURE = Path(os.environ.get("FLOORLINE_RECORDED_VECTORS", "recorded-vectors.json"))


def frame(spark, labels, durations, vectors=None):
    rows = [("r", i, l, float(d), [float(x) for x in (vectors[i] if vectors is not None else [1.0])]) for i, (l, d) in enumerate(zip(labels, durations))]
    return spark.createDataFrame(rows, "recording_id string, idx long, label int, duration_ms double, vector array<double>")


def column(df):
    return [r.label for r in df.orderBy("idx").collect()]


def ranked(labels, durations, k):
    """Labels in order of their speech, then of their first sample, one by one."""
    total, seen = {}, []
    for l, d in zip(labels, durations):
        seen += [l] if l not in total else []
        total[l] = total.get(l, 0) + d
    order = sorted(seen, key=lambda l: -total[l])  # stable: equals stay in order of appearance
    return [order.index(l) if order.index(l) < k else -1 for l in labels]


def labelled_runs(seed, n):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 6, n).tolist(), (rng.integers(1, 5, n) * 250.0).tolist()


@pytest.mark.parametrize("seed, n, k", [(0, 30, 3), (1, 7, 2), (2, 12, 0), (3, 25, 9), (4, 1, 1)])
def test_keep_busiest(spark, seed, n, k):
    labels, durations = labelled_runs(seed, n)
    wanted = ranked(labels, durations, k)
    assert c.busiest(np.array(labels), np.array(durations), k).tolist() == wanted
    assert column(c.keep_busiest(frame(spark, labels, durations), k)) == wanted


@pytest.mark.parametrize("k", [2, 3, 5])
def test_recovers_voices(k):
    v, truth = make_voices(k, 8)
    assert c.average_linkage(v, k=k).tolist() == truth.tolist()


def test_linkage_limits():
    v, _ = make_voices(3, 4)
    assert set(c.average_linkage(v, threshold=2)) == {0}
    assert c.average_linkage(v, threshold=-0.5).tolist() == list(range(12))
    assert c.average_linkage(v[:2], k=10).tolist() == [0, 1]
    assert c.average_linkage(v[:0]).tolist() == [] and c.average_linkage(v[:1]).tolist() == [0]
    assert set(c.average_linkage(v)) == {0}
    assert len(set(c.average_linkage(v, k=3, threshold=0.0))) == 3  # a count beats a threshold


def test_linkage_matches_plain_rescan():
    rng = np.random.default_rng(1)
    for n in (2, 5, 17, 40, 70):
        v = c.unit(rng.normal(size=(n, 8)))
        d = (1 - v @ v.T).astype(np.float32)
        groups = [[i] for i in range(n)]
        while len(groups) > 3:
            best = min(((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
            groups[best[1]] += groups.pop(best[2])
        labels = np.zeros(n, int)
        for g, members in enumerate(groups):
            labels[members] = g
        assert c.average_linkage(v, k=3).tolist() == c.renumbered(labels).tolist()


@pytest.mark.skipif(not FIXTURE.exists(), reason="the recorded vectors aren't here")
def test_real_vectors_need_centring():
    data = json.loads(FIXTURE.read_text())
    v, ms = np.array(data["vectors"]), np.array(data["durationsMs"], float)
    share = lambda labels: round(100 * ms[labels == 0].sum() / ms.sum())
    top = lambda labels: max(share(labels), 100 - share(labels))
    assert top(c.average_linkage(v, k=2)) == 91
    assert top(c.average_linkage(c.centred(v), k=2)) == 58


def test_absorb_and_place(spark):
    v, truth = make_voices(2, 3)
    labels = truth.copy()
    labels[0] = 9  # a lone short sample of the first voice
    ms = np.full(6, 1000.0)
    assert c.absorbed(v, labels, ms).tolist() == [0, 1, 0, 1, 0, 1]
    assert column(c.absorb_tiny(frame(spark, labels.tolist(), ms, v))) == [0, 1, 0, 1, 0, 1]
    stray = truth.copy()
    stray[[0, 3]] = -1
    assert c.placed(v, stray, ms).tolist() == truth.tolist()
    assert column(c.place_splinters(frame(spark, stray.tolist(), ms, v))) == truth.tolist()
    assert column(c.place_splinters(frame(spark, [-1] * 6, ms, v))) == [-1] * 6


def test_policies():
    v, truth = make_voices(3, 10)
    ms = np.full(30, 1500.0)
    for k in (3, None):
        assert c.labels_by_policy(v, ms, k).tolist() == truth.tolist()
    assert set(c.labels_by_policy(v, ms, 2, background=True)) == {-1, 0, 1}
    assert c.labels_by_policy(v[:0], ms[:0], 2).tolist() == []


def plain_carry(labels, previous, ms, next_id):
    """Claims looked for anew each time: the largest that is left, of equals the lower label, then identity as it comes."""
    left = [(l, p) for l, p in zip(labels, previous) if l != -1 and p != -1]
    claim = lambda l, p: sum(m for a, b, m in zip(labels, previous, ms) if (a, b) == (l, p))
    given = {}
    while left:
        most = max(claim(l, p) for l, p in left)
        if most <= 0:
            break
        l, p = min(((l, p) for l, p in left if claim(l, p) == most), key=lambda x: x[0])
        given[l] = p
        left = [(a, b) for a, b in left if a != l and b != p]
    vacant = sorted(set(previous) - {-1} - set(given.values()))
    for l in labels:
        if l != -1 and l not in given:
            given[l] = vacant.pop(0) if vacant else next_id
            next_id += given[l] == next_id
    return [given.get(l, -1) for l in labels], next_id


@pytest.mark.parametrize("seed", range(40))
def test_carry(seed):
    rng = np.random.default_rng(seed)
    n, known = int(rng.integers(0, 30)), int(rng.integers(0, 30))
    labels = rng.integers(-1, 5, n).tolist()
    previous = (rng.permutation(9)[rng.integers(0, 5, min(n, known))] - (seed % 3 == 0)).tolist()
    ms = rng.random(n).tolist()  # no two claims are equal
    next_id = max(previous, default=-1) + 1
    assert carry(labels, previous, ms, next_id) == plain_carry(labels, previous, ms, next_id)


def test_identities_are_kept_when_labels_change_places():
    labels, ms = [1, 1, 0, 2, 0, -1], [100.0, 300.0, 50.0, 75.0, 20.0, 900.0]
    assert carry(labels, [], ms, 0) == ([0, 0, 1, 2, 1, -1], 3)
    assert carry([4, 4, 8, 6, 8, 6, 9], [0, 0, 1, 2, 1], [*ms[:5], 10.0, 10.0], 3) == ([0, 0, 1, 2, 1, 2, 3], 4)


def test_profiles():
    rng = np.random.default_rng(6)
    v, w = rng.normal(size=(9, 5)), rng.integers(1, 9, 9) * 500.0
    p, empty = Profile(), Profile()
    assert empty.centroid is None and nearest_profile(v[0], [empty, empty]) is None
    for x, ms in zip(v, w):
        p.add(x, ms)
    mean = (v * w[:, None]).sum(axis=0)
    assert np.allclose(p.centroid, mean / np.linalg.norm(mean)) and p.ms == w.sum()
    assert nearest_profile(c.unit(mean), [empty, p])[::2] == (1, float("inf"))
    others = [Profile(total=x) for x in rng.normal(size=(4, 5))]
    far = sorted((1 - float(c.unit(v[0]) @ o.centroid), i) for i, o in enumerate(others))
    who, distance, margin = nearest_profile(c.unit(v[0]), others)
    assert (who, distance) == pytest.approx((far[0][1], far[0][0])) and margin == pytest.approx(far[1][0] - far[0][0])
    assert nearest_profile(v[0], [p, p])[0] == 0  # of equals the first


def plain_alerts(heard, rule):
    """All far samples looked at anew for each: it is told if it completes a run, and nothing was told since the last pause."""
    far, out = [h for h in heard if h[2] > rule.distance], []
    for n, (start, *_) in enumerate(far):
        pauses = [far[i][0] for i in range(1, n + 1) if far[i][0] - far[i - 1][0] >= rule.pause_ms]
        run = [(s, m) for s, m, _ in far[: n + 1] if start - s <= rule.within_ms]
        if len(run) >= rule.samples and sum(m for _, m in run) >= rule.ms and not any(at >= max(pauses, default=0) for at, _ in out):
            out.append((start, run))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_far_stretches_are_told_of_once(spark, seed):
    rng, rule = np.random.default_rng(seed), FarRule()
    steps = rng.choice([2_000, 9_000, 31_000, 70_000, 119_000, 120_000, 260_000], 120, p=[0.3, 0.3, 0.15, 0.1, 0.05, 0.05, 0.05])
    heard = [(float(t), float(m), float(x)) for t, m, x in zip(np.cumsum(steps), rng.integers(2, 9, 120) * 250, rng.choice([0.3, 0.75, 0.76, 1.2], 120))]
    stretch, told = FarStretch(rule), []
    for start, ms, distance in heard:
        if distance > rule.distance and (run := stretch.hear(start, ms)):
            told.append((start, run))
    assert told == plain_alerts(heard, rule)
    if seed < 3:
        rows = spark.createDataFrame([("r", i, *h) for i, h in enumerate(heard)], "recording_id string, idx long, start_ms double, duration_ms double, distance double")
        got = [(heard[r.idx][0], r.from_ms, r.samples, r.ms) for r in far_runs(rows, rule).orderBy("idx").collect()]
        assert got == [(at, run[0][0], len(run), sum(m for _, m in run)) for at, run in told]


def test_replay_settles():
    v, truth = make_voices(2, 6)
    ends = np.arange(12) * 3000.0 + 2000
    steps = replay(v, ends, np.full(12, 2000.0), 2)
    assert steps[-1][1] == truth.tolist() and len(steps[0][1]) < 12


def test_linkage_with_many_ties():
    """Vectors that repeat: equal distances go to the lowest numbers, as a search of all pairs each time has it."""
    rng = np.random.default_rng(2)
    v = c.unit(rng.integers(-1, 2, (60, 3)).astype(float) + 1e-12)
    d = (1.0 - v @ v.T).astype(np.float32)
    owner, size, alive = np.arange(60), np.ones(60), list(range(60))
    while len(alive) > 4:
        _, x, y = min((d[min(a, b), max(a, b)], a, b) for n, a in enumerate(alive) for b in alive[n + 1 :])
        for z in alive:
            if z not in (x, y):
                i, j = (min(x, z), max(x, z)), (min(y, z), max(y, z))
                d[i] = np.float32((np.float64(d[i]) * size[x] + np.float64(d[j]) * size[y]) / (size[x] + size[y]))
        size[x] += size[y]
        owner[owner == y] = x
        alive.remove(y)
    assert c.average_linkage(v, k=4).tolist() == c.renumbered(owner).tolist()


def test_growth_and_sweep(spark):
    v, truth = make_voices(3, 8)
    df = frame(spark, truth.tolist(), [1500.0] * 24, v).withColumn("start_ms", F.col("idx") * 10_000.0 + 7).withColumn("end_ms", F.col("start_ms") + 1500)
    got = {r.minutes: (r.samples, r.groups, r.absorbed) for r in c.growth(df, (0.01, 1.5, 99)).collect()}
    near = lambda n: c.average_linkage(v[:n], threshold=c.C.AUTOMATIC_THRESHOLD)
    assert got == {0.01: (0, 0, 0), 1.5: (9, len(set(near(9))), len(set(c.absorbed(v[:9], near(9), np.full(9, 1500.0))))), 99.0: (24, 3, 3)}
    found = {r.threshold: (r.groups, r.absorbed) for r in c.sweep(df, (-0.5, 0.7, 2.0)).collect()}
    assert found == {-0.5: (24, 24), 0.7: (3, 3), 2.0: (1, 1)}


def test_held_final():
    steps = [(0, [0, 0, 1], 0), (1, [0, 1, 1, 2, -1], 1), (2, [5, 1, 1, 2, -1, 0], 1)]
    assert held_final(steps) == {0: [0, 1, 5], 1: [1], 2: [2], 5: [5]} and held_final([]) == {}


def test_viterbi_without_penalty_is_nearest(spark):
    v, truth = make_voices(2, 4)
    starts = np.arange(8) * 1000.0
    assert c.smoothed_labels(v, truth, np.ones(8), starts, starts + 900, 0.0, 2000).tolist() == truth.tolist()
    assert len(set(c.smoothed_labels(v, truth, np.ones(8), starts, starts + 900, 50.0, 1e9).tolist())) == 1
