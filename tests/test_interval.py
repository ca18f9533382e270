import pytest
from pyspark.sql import functions as F

from floorline.operators import interval

S = "recording_id string, idx long, start_ms long, end_ms long"


def spans(spark, rows):
    return spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(rows)], S)


@pytest.mark.parametrize(
    "attributed, overlaps, credited",
    [
        ([(0, 2000), (5000, 7000)], [(2000, 3000)], [1000, 0]),
        ([(0, 2000), (9000, 10000)], [(2500, 3000), (4000, 5500)], [2000, 0]),
        ([(3000, 5000)], [(1000, 2000)], [0]),
        ([(0, 1000), (1500, 3000)], [(1000, 1500)], [500, 0]),
        ([(0, 1000), (1500, 3000)], [(500, 600), (1000, 1500), (3000, 3500)], [500, 500]),
        ([(0, 1000)], [], [0]),
        ([], [(0, 1000)], []),
    ],
)
def test_credit(spark, attributed, overlaps, credited):
    out = interval.credit_overlap(spans(spark, attributed), spans(spark, overlaps)).orderBy("idx").collect()
    assert [r.credited_ms for r in out] == credited


def test_rules(spark):
    owned = interval.overlap_owners(spans(spark, [(2000, 3000)]), spans(spark, [(0, 500), (3100, 4000)]))
    got = {(r.rule, r.start_ms, r.end_ms): r.owner for r in owned.collect()}
    assert got == {("before", 2000, 3000): 0, ("after", 2000, 3000): 1, ("nearer", 2000, 3000): 1, ("split", 2000, 2500): 0, ("split", 2500, 3000): 1}


def test_overlap_join_is_each_pair_once(spark):
    a = spans(spark, [(0, 35000), (40000, 41000), (50000, 50000)])
    b = spans(spark, [(100, 60000), (34999, 40001), (20000, 20001)])
    got = sorted((r.idx, r.b_idx, r.shared_ms) for r in interval.overlap_join(a, b).collect())
    assert got == [(0, 0, 34900), (0, 1, 1), (0, 2, 1), (1, 0, 1000), (1, 1, 1)]


def test_majority(spark):
    turns = spans(spark, [(0, 1000), (1000, 1300), (5000, 6000)]).withColumn("speaker", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("A")), (F.col("idx") + 1).cast("int")))
    found = interval.majority_speaker(spans(spark, [(0, 1100), (900, 1300), (2000, 3000), (4500, 5500)]), turns).orderBy("idx").collect()
    assert [r.truth for r in found] == ["A", "B", "?", "?"]  # a quarter isn't over a quarter


def test_speaker_at_longest_then_first(spark):
    turns = spans(spark, [(0, 1000), (500, 1500), (0, 3000)]).withColumn("speaker", F.col("idx").cast("string"))
    pts = spark.createDataFrame([("r", 600), ("r", 5000), ("q", 1)], "recording_id string, at_ms long")
    got = {(r.recording_id, r.at_ms): r.who for r in interval.speaker_at(pts, turns).collect()}
    assert got == {("r", 600): "2", ("r", 5000): None, ("q", 1): None}


def test_periods(spark):
    periods = spark.createDataFrame([("r", 0, 0.0, 5.0), ("r", 1, 5.0, None)], "recording_id string, period int, from_ms double, to_ms double")
    pts = spark.createDataFrame([("r", 0.0), ("r", 5.0), ("r", 99.0), ("q", 1.0)], "recording_id string, mid_ms double")
    assert sorted((r.recording_id, r.mid_ms, r.period) for r in interval.period_of(pts, periods).where("recording_id = 'r'").collect()) == [("r", 0.0, 0), ("r", 5.0, 1), ("r", 99.0, 1)]


def test_equal_points_stay_points_of_their_own(spark):
    turns = spans(spark, [(0, 1000), (500, 1500)]).withColumn("speaker", F.col("idx").cast("string"))
    pts = spark.createDataFrame([("r", 600)] * 3 + [("r", 1200), ("q", 1), ("q", 1)], "recording_id string, at_ms long")
    assert sorted((r.recording_id, r.at_ms, r.who or "") for r in interval.speaker_at(pts, turns).collect()) == sorted([("r", 600, "0")] * 3 + [("r", 1200, "1")] + [("q", 1, "")] * 2)
    periods = spark.createDataFrame([("r", 0, 0.0, 25_000.0), ("r", 1, 20_000.0, None), ("r", 2, 30_000.0, float("inf")), ("r", 3, 5.0, 5.0)], "recording_id string, period int, from_ms double, to_ms double")
    pts = spark.createDataFrame([("r", 10.0)] * 2 + [("r", 24_999.0), ("r", 25_000.0), ("r", 40_000.0), ("r", -1.0), ("q", 10.0)], "recording_id string, mid_ms double")
    got = sorted((r.recording_id, r.mid_ms, -1 if r.period is None else r.period) for r in interval.period_of(pts, periods).collect())
    assert got == sorted([("r", 10.0, 0)] * 2 + [("r", 24_999.0, 0), ("r", 25_000.0, 1), ("r", 40_000.0, 1), ("r", -1.0, -1), ("q", 10.0, -1)])


def test_periods_do_not_meet_all_points(spark):
    periods = spark.createDataFrame([("r", 0, 0.0, 5.0)], "recording_id string, period int, from_ms double, to_ms double")
    pts = spark.createDataFrame([("r", 0.0)], "recording_id string, mid_ms double")
    assert "b_bin" in interval.period_of(pts, periods)._jdf.queryExecution().optimizedPlan().toString()
