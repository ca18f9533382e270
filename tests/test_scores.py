import pytest
from pyspark.sql import functions as F

from floorline.functions import constants as C, scalars
from floorline.operators import score, tally

T = "recording_id string, idx long, start_ms double, end_ms double, speaker string"
REF = [(0, 1000, "A"), (1000, 2000, "B"), (3000, 4000, "A")]


def turns(spark, rows):
    return spark.createDataFrame([("r", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], T)


def der(spark, ref, hyp, total=5000):
    out = score.diarization_error(turns(spark, ref), turns(spark, hyp), spark.createDataFrame([("r", total)], "recording_id string, total_ms long")).collect()
    return out[0].der if out else 0.0


@pytest.mark.parametrize(
    "hyp, wanted",
    [
        ([(0, 1000, "x"), (1000, 2000, "y"), (3000, 4000, "x")], 0),
        ([(0, 1000, "x"), (1000, 2000, "x"), (3000, 4000, "x")], 1 / 3),
        ([(0, 1000, "x")], 2 / 3),
        ([(0, 1000, "x"), (1000, 3000, "y"), (3000, 4000, "x")], 1 / 3),
        ([], 1),
    ],
)
def test_error_rate(spark, hyp, wanted):
    assert der(spark, REF, hyp) == pytest.approx(wanted)


def test_no_reference(spark):
    assert der(spark, [], [(0, 1000, "x")]) == 0


def raster(spark, rows):
    totals = spark.createDataFrame([("r", 100)], "recording_id string, total_ms long")
    out = {}
    for r in score.rasterise(turns(spark, rows), totals).collect():
        for f in range(r.frame, r.frame + r.frames):
            assert f not in out
            out[f] = r.speaker
    return out


def test_raster_longest_then_later(spark):
    got = raster(spark, [(0, 100, "A"), (20, 40, "B"), (30, 50, "C")])
    assert set(got.values()) == {"A"} and len(got) == 10
    assert raster(spark, [(0, 30, "A"), (10, 40, "B")]) == {0: "A", 1: "B", 2: "B", 3: "B"}
    assert raster(spark, [(5, 12, "A"), (95, 300, "B"), (40, 40, "C")]) == {0: "A", 1: "A", 9: "B"}


def test_stretches_count_what_frames_count(spark):
    """Error counters, coverage and edges from stretches against the same frame by frame."""
    import random

    rng, total = random.Random(4), 30_000
    cut = lambda: sorted(rng.sample(range(0, total), 2))
    ref, hyp, quiet = ([(*cut(), rng.choice("ABC")) for _ in range(n)] for n in (14, 12, 9))
    frames = lambda a, b, most=total: range(a // 10, min(-(-most // 10), -(-b // 10)))

    def plain(rows):
        best = {}
        for i, (a, b, s) in enumerate(rows):
            for f in frames(a, b):
                best[f] = max(best.get(f, (-1, -1, "")), (b - a, i, s))
        return {f: x[2] for f, x in best.items()}

    totals = spark.createDataFrame([("r", total)], "recording_id string, total_ms long")
    a, b = plain(ref), plain(hyp)
    got = score.error_counters(score.aligned(turns(spark, ref), turns(spark, hyp), totals)).first()
    both = {f: (a.get(f), b.get(f)) for f in {*a, *b}}.values()
    assert (got.missed_ms, got.false_alarm_ms) == (10 * sum(y is None for _, y in both), 10 * sum(x is None for x, _ in both))
    assert (got.correct_ms, got.reference_ms) == (10 * sum(x == y for x, y in both), 10 * len(a))
    heard = {f for s, e, _ in quiet for f in frames(s, e, 10**9)}
    want = {}
    for f in heard:
        near = [min(f * 10 + 5 - s, e - f * 10 - 5) for s, e, _ in ref if f in frames(s, e, 10**9)]
        if len(near) == 1:
            bucket = sum(near[0] >= low for low in C.EDGE_BUCKETS_MS[1:])
            want[bucket] = want.get(bucket, 0) + 1
    edges = score.edge_histogram(turns(spark, ref), turns(spark, quiet)).collect()
    assert {r.bucket: r.frames for r in edges} == want
    state = {}
    for i, (s, e, name) in enumerate(hyp):
        for f in frames(s, e):
            state[f] = name
    count = {}
    for f, name in state.items():
        n = min(2, sum(f in frames(s, e) for s, e, _ in ref))
        count[n, name] = count.get((n, name), 0) + 1
    seen = score.coverage(turns(spark, ref), turns(spark, hyp).withColumnRenamed("speaker", "state"), totals).collect()
    assert {(r.ref_bucket, r.state): r.frames for r in seen} == count


def test_share_error(spark):
    s = "recording_id string, speaker string, ms double"
    a = spark.createDataFrame([("r", "A", 600.0), ("r", "B", 400.0)], s)
    b = spark.createDataFrame([("r", "A", 500.0), ("r", "C", 500.0)], s)
    assert score.share_error(a, b).first().share_error == pytest.approx(0.5)


def test_overlap_flag(spark):
    s = "recording_id string, label int, duration_ms double, credited_ms double"
    rows = [("a", 0, 1000.0, 0.0), ("a", 1, 1000.0, 500.0), ("a", -1, 1000.0, 900.0), ("b", 0, 1000.0, 1000.0), ("b", 1, 1000.0, 1000.0), ("c", -1, 10.0, 0.0)]
    got = {r.recording_id: (round(r.overlap_share, 6), r.heavy) for r in tally.overlap_flag(spark.createDataFrame(rows, s)).collect()}
    assert got == {"a": (0.2, False), "b": (0.5, True), "c": (0.0, False)}


def test_reliability(spark):
    cases = [(2, 2, "low"), (12, 2, "good"), (6, 2, "good"), (5, 2, "low"), (9, 3, "good"), (9, 4, "low"), (0, 0, "insufficient"), (1, 1, "insufficient")]
    df = spark.createDataFrame(cases, "n int, k int, wanted string")
    assert df.where(scalars.reliability(F.col("n"), F.col("k")) != F.col("wanted")).count() == 0


def test_clarity_of_orthogonal_axes(spark):
    rows = [("r", i, 0, 1000.0, [1.0 if d == i else 0.0 for d in range(8)]) for i in range(8)] + [("q", 0, 0, 1.0, [1.0]), ("q", 1, 0, 1.0, [1.0])]
    df = spark.createDataFrame(rows, "recording_id string, idx long, label int, duration_ms double, vector array<double>")
    got = {r.recording_id: (round(r.spread, 3), r.clear) for r in tally.clarity(df).collect()}
    assert got == {"r": (0.646, False), "q": (0.0, True)}


def test_head_count(spark):
    def k(calibrated, count, names):
        return spark.range(1).select(scalars.resolve_count(F.lit(calibrated), F.lit(count).cast("double"), F.array(*(F.lit(n) for n in names)).cast("array<string>"))["k"]).first()[0]

    assert k(3, None, ["a", "b"]) == 3 and k(None, 4, ["a", "b"]) == 4 and k(None, 1, []) is None and k(None, 0, ["a", "b"]) == 2
    assert k(None, 3.5, []) is None and k(None, float("nan"), []) is None and k(None, None, ["a", " "]) is None


def test_small_rules(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert [v(scalars.splinter_headroom(F.lit(n))) for n in (0, 24, 25, 55, 178, 227, 10000)] == [0, 0, 1, 2, 7, 8, 8]
    assert v(scalars.parse_names(F.lit(" Ilse, Pavel ,, Noor "))) == ["Ilse", "Pavel", "Noor"]
    assert v(scalars.clock(F.lit(61_499.0))) == "1:01" and v(scalars.clock(F.lit(-5.0))) == "0:00"
    assert v(scalars.rounded4(F.lit(-0.00005))) == 0.0 and v(scalars.percent(F.lit(0.125))) == 13
    assert v(scalars.next_count(F.lit(False), F.lit("7"), scalars.parse_names(F.lit("a,b")))) == "2"
    assert v(scalars.live_warning(F.lit(9), F.lit(False), F.lit("good"), F.lit(False), F.lit(True))) == "unclear overlap"
    assert v(scalars.window_number(F.lit(7500.0))) == 0 and v(scalars.window_number(F.lit(7501.0))) == 1
    assert v(scalars.on_boundary(F.lit(7_540.0))) and not v(scalars.on_boundary(F.lit(9_000.0)))


def test_rules_for_overlaps_by_error(spark):
    ref = turns(spark, [(0, 1500, "A"), (1500, 3000, "B")])
    own = turns(spark, [(0, 1000, "x"), (2000, 3000, "y")])
    both = turns(spark, [(1000, 2000, None)]).drop("speaker")
    totals = spark.createDataFrame([("r", 3000)], "recording_id string, total_ms long")
    got = {r.rule: (r.missed_ms, r.confusion_ms, r.correct_ms, round(r.der, 6)) for r in score.overlap_rule_errors(ref, own, both, totals).collect()}
    assert got == {"none": (1000, 0, 2000, 0.333333), "before": (0, 500, 2500, 0.166667), "after": (0, 500, 2500, 0.166667), "nearer": (0, 500, 2500, 0.166667), "split": (0, 0, 3000, 0.0), "within_1s": (0, 500, 2500, 0.166667)}


def test_matching_is_no_python_group(spark):
    """A recording and rule is a row, not a group of its own in Python, of which there are six a recording."""
    counts = spark.createDataFrame([(1, "b", "x", 5), (1, "a", "x", 5), (1, "a", "y", 4), (1, "b", "y", 1), (1, None, "x", 99), (2, "a", None, 3)], "recording_id long, hyp string, ref string, n long")
    assert sorted(map(tuple, score.greedy_match(counts).collect())) == [(1, "a", "x"), (1, "b", "y")]
    turns = spark.createDataFrame([(1, 0, 0, 900, "x")], "recording_id long, idx long, start_ms long, end_ms long, speaker string")
    totals = spark.createDataFrame([(1, 900)], "recording_id long, total_ms long")
    found = score.overlap_rule_errors(turns, turns, turns, totals)
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
