import pytest
from pyspark.sql import functions as F

from floorline.operators import timeline as t


def plan(spark, *totals):
    df = spark.createDataFrame([(f"r{i}", float(x)) for i, x in enumerate(totals)], "recording_id string, total_ms double")
    return [tuple(r)[1:] for r in t.window_plan(df).orderBy("recording_id", "window").collect()]


@pytest.mark.parametrize(
    "total, rows",
    [
        (0, []),
        (-5, []),
        (4000, [(0, 0, 4000, 0, 4000)]),
        (10000, [(0, 0, 10000, 0, 10000)]),
        (12000, [(0, 0, 10000, 0, 6000), (1, 2000, 12000, 6000, 12000)]),
        (20000, [(0, 0, 10000, 0, 7500), (1, 5000, 15000, 7500, 12500), (2, 10000, 20000, 12500, 20000)]),
    ],
)
def test_window_plan(spark, total, rows):
    assert plan(spark, total) == rows


def test_trust_regions_tile(spark):
    for total in (33000, 10001, 15000, 61234):
        rows = plan(spark, total)
        edges = [r[3] for r in rows] + [rows[-1][4]]
        assert edges[0] == 0 and edges[-1] == total
        assert all(a[4] == b[3] for a, b in zip(rows, rows[1:]))
    assert [r[3] for r in plan(spark, 33000)] == [0, 7500, 12500, 17500, 22500, 26500]


def decode(spark, classes, duration):
    logits = [10.0 if c == k else -10.0 for k in classes for c in range(7)]
    df = spark.createDataFrame([("r", 0, 0.0, float(duration), 0.0, float(duration), logits)], "recording_id string, window int, start_ms double, end_ms double, trust_from_ms double, trust_to_ms double, logits array<float>")
    return [(r.speakers, r.start_ms, r.end_ms) for r in t.decode_windows(df).orderBy("idx").collect()]


def test_decode(spark):
    assert decode(spark, [0, 1, 1, 1, 0], 500) == [([], 0, 100), ([0], 100, 400), ([], 400, 500)]
    assert decode(spark, [1, 1, 2, 2], 400) == [([0], 0, 200), ([1], 200, 400)]
    assert decode(spark, [1, 4, 2], 300) == [([0], 0, 100), ([0, 1], 100, 200), ([1], 200, 300)]
    assert decode(spark, [1], 100) == [([0], 0, 100)]
    assert decode(spark, [], 0) == []


def test_arg_max_ties_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([nan, 1.0, 0.0],), ([nan, nan, nan],), ([2.0, None, 1.0],)], "l array<double>")
    assert [r[0] for r in df.select(t.arg_max(F.col("l"))).collect()] == [1, 1, 0, 0]


def test_single_speaker_keeps_long_ones(spark):
    df = spark.createDataFrame([("r", 0, 200, []), ("r", 200, 400, [0]), ("r", 400, 1200, [1]), ("r", 2000, 4000, [0, 1])], "recording_id string, start_ms long, end_ms long, speakers array<int>")
    assert [(r.start_ms, r.end_ms) for r in t.single_speaker(df).collect()] == [(400, 1200)]
    assert t.overlapped(df).count() == 1 and t.silent(df).count() == 1


def test_foreground(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 0.01, 1.0])] + [("b", i, x) for i, x in enumerate([1.0, 1.0, 0.44, 0.45, 1.0])], "recording_id string, idx int, level double")
    kept = {(r.recording_id, r.idx): r.keep for r in t.foreground(df).collect()}
    assert all(kept["a", i] for i in range(3))
    assert [kept["b", i] for i in range(5)] == [True, True, False, True, True]


def test_sub_windows_and_touching(spark):
    df = spark.createDataFrame([("r", 0, 0, 1500), ("r", 1, 1540, 6000)], "recording_id string, idx long, start_ms long, end_ms long")
    assert [(r.idx, r.start_ms, r.end_ms) for r in t.sub_windows(df, 2000, 1000).orderBy("idx", "piece").collect()] == [(0, 0, 1500), (1, 1540, 3540), (1, 2540, 4540), (1, 3540, 5540)]
    assert [(r.start_ms, r.end_ms) for r in t.merge_touching(df, 60).collect()] == [(0, 6000)]
