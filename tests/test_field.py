from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.functions import constants as C
from floorline.operators import cluster, field, identity, reports, segments

SCHEMA = "recording_id string, idx long, start_ms double, end_ms double, duration_ms double, level double, truth string, vector array<double>"
TURNS = "recording_id string, idx long, start_ms double, end_ms double, speaker string"


def talk(seed: int, n: int = 40, people: int = 3):
    """Vectors about ``people`` directions, a fifth of them about the wrong one."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, people, n)
    seen = np.where(rng.random(n) < 0.2, (truth + 1) % people, truth)
    v = np.eye(people, 8)[seen] + 0.3 * rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.integers(500, 8000, n).astype(float)
    start = np.cumsum(w) - w + 100
    return v, w, start, truth


def rows_of(v, w, start, truth, name="r"):
    return [(name, i, float(start[i]), float(start[i] + w[i]), float(w[i]), 0.01 * (i % 7), f"p{truth[i]}", [float(x) for x in v[i]]) for i in range(len(w))]


def test_diagnosis_against_a_plain_count(spark):
    v, w, start, truth = talk(3)
    rows = rows_of(v, w, start, truth)
    rows[4], rows[9] = (*rows[4][:6], "?", rows[4][7]), (*rows[9][:6], "mixed", rows[9][7])
    turns = [("r", i, float(start[i] - 200), float(start[i] + w[i] * (0.6 if i % 3 else 1.0)), f"p{truth[i]}") for i in range(len(w))]
    found = segments.diagnose(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(turns, TURNS)).cache()

    x, known = cluster.centred(v), [i for i in range(len(w)) if i not in (4, 9)]
    centres = {p: sum(x[i] * w[i] for i in known if truth[i] == p) for p in range(3)}
    centres = {p: c / np.linalg.norm(c) for p, c in centres.items()}
    plain = {}
    for i in known:
        far = {p: 1 - x[i] @ c for p, c in centres.items()}
        cover = Counter()
        for _, _, a, b, who in turns:
            cover[who] += max(0.0, min(b, start[i] + w[i]) - max(a, start[i]))
        own = cover[f"p{truth[i]}"] / w[i]
        plain[i] = (min(far, key=far.get), far[truth[i]], own, sum(cover.values()) / w[i] - own)
    got = {r.idx: r for r in found.collect()}
    assert set(got) == set(plain)
    for i, (nearest, far, own, others) in plain.items():
        assert got[i].nearest == f"p{nearest}" and got[i].misplaced == (nearest != truth[i]) and got[i].minute == start[i] // 60_000
        assert (got[i].own_distance, got[i].purity, got[i].others) == pytest.approx((far, own, others))
    off = [i for i in plain if plain[i][0] != truth[i]]
    assert off  # the case has something to find

    for r in segments.contrast(found).collect():
        mine = [i for i in plain if f"p{truth[i]}" == r.own]
        bad, good = sorted(w[i] for i in mine if i in off), sorted(w[i] for i in mine if i not in off)
        assert (r.segments, r.misplaced) == (len(mine), len(bad)) and r.crowded_misplaced == sum(plain[i][3] > 0 for i in mine if i in off)
        assert r.duration_ms_placed == good[len(good) // 2] and r.duration_ms_misplaced == (bad[len(bad) // 2] if bad else None)
    drawn = Counter((f"p{truth[i]}", f"p{plain[i][0]}") for i in off)
    assert {(r.own, r.nearest): r.segments for r in segments.drawn_to(found).collect()} == drawn
    bins = Counter()
    for i in plain:
        bins["duration_ms", float(max(b for b in C.DURATION_BUCKETS_MS if w[i] >= b))] += 1
        bins["purity", next((b for b in segments.PURITY_BINS if plain[i][2] >= b), 0.0)] += 1
    rates = segments.rates(found).collect()
    assert {(r.measure, r.least): r.segments for r in rates} == bins and sum(r.misplaced for r in rates) == 2 * len(off)


def test_diagnosis_of_odd_rows(spark):
    v, w, start, truth = talk(5, 12)
    rows = rows_of(v, w, start, truth)
    rows[2] = (*rows[2][:3], rows[2][2], 0.0, None, *rows[2][6:])  # no length, no level
    rows[3] = (*rows[3][:7], None)  # no vector
    rows[5] = (*rows[5][:6], None, rows[5][7])  # nobody
    samples = spark.createDataFrame(rows, SCHEMA).withColumn("speaker", F.lit("clash"))
    got = {r.idx: r for r in segments.diagnose(samples, spark.createDataFrame([], TURNS)).collect()}
    assert set(got) == set(range(12)) - {5}
    assert got[2].purity is None and got[3].nearest is None and not got[3].misplaced and got[0].purity == 0 and got[0].unannotated == 1
    empty = segments.diagnose(samples.limit(0), spark.createDataFrame([], TURNS))
    assert not empty.collect() and not segments.rates(empty).collect() and not segments.contrast(empty).collect()


@pytest.mark.parametrize("background", [False, True])
def test_alternatives_are_what_the_policy_gives(spark, background):
    v, w, start, truth = talk(11, 60, 4)
    rows = spark.createDataFrame(rows_of(v, w, start, truth), SCHEMA).withColumn("label", F.substring("truth", 2, 1).cast("int"))
    plain = Counter()
    for people in (2, 4):
        for voice, label, ms in zip(cluster.labels_by_policy(v, w, people, background), truth, w, strict=True):
            plain[people, int(voice), int(label)] += ms
    assert {(r.people, r.voice, r.label): r.ms for r in field.alternatives(rows, 3, background).collect()} == plain
    assert {r.people for r in field.alternatives(rows, 2, background).select("people").distinct().collect()} == {3}


def test_distances_between_people(spark):
    v, w, start, truth = talk(2)
    x = cluster.centred(v)
    centres = [(lambda c: c / np.linalg.norm(c))(sum(x[i] * w[i] for i in range(len(w)) if truth[i] == p)) for p in range(3)]
    rows = spark.createDataFrame(rows_of(v, w, start, truth), SCHEMA).withColumn("label", F.substring("truth", 2, 1).cast("int"))
    got = {(r.a, r.b): r.distance for r in field.people_distances(rows).collect()}
    assert got == {(a, b): pytest.approx(1 - centres[a] @ centres[b]) for a in range(3) for b in range(a + 1, 3)}


def test_appearances_follow_the_replay(spark):
    v, w, start, truth = talk(8, 30)
    steps = identity.replay(v, start + w, w, 3)
    first = {}
    for window, shown, _ in steps:
        for who in shown:
            first.setdefault(who, 7500 + 5000 * window)
    heard = len({who for who, end in zip(steps[-1][1], start + w, strict=True) if end <= max(first.values())})
    got = field.appearances(spark.createDataFrame(rows_of(v, w, start, truth), SCHEMA), 3).collect()
    assert {r.identity: r.first_ms for r in got} == first and {r.heard for r in got} == {heard}


def test_log_report(spark):
    log = spark.createDataFrame([("r", "error", 5, "b"), ("r", "error", 5, "a"), ("r", "error", 9, "0"), ("r", "window", 7, None)], "recording_id string, kind string, at_ms long, detail string")
    assert {tuple(r) for r in field.log_report(log).collect()} == {("r", "error", 3, 5, "a"), ("r", "window", 1, 7, None)}


def test_replay_starts_where_the_recording_does(spark):
    """Times that count from far back cost nothing, the replay is planned once and dealt over tasks."""
    v, ms = np.eye(3)[[0, 1, 0, 1]], np.full(4, 1000.0)
    at = np.array([7_000.0, 12_000, 17_000, 37_000])
    near, far = identity.replay(v, at, ms, 2), identity.replay(v, at + 5e15, ms, 2)
    assert [(w - int(5e15) // 5_000, ids, n) for w, ids, n in far] == near and len(near) == 7
    rows = [(r, i, int(at[i]) - 1000, int(at[i]), 1000, v[i].tolist()) for r in range(24) for i in range(4)]
    samples = spark.createDataFrame(rows, "recording_id long, idx long, start_ms long, end_ms long, duration_ms long, vector array<double>")
    assert identity.replay_sessions(samples, 2).select(F.spark_partition_id()).distinct().count() > 1
    plan = field.appearances(samples, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
