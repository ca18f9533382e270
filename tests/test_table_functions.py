from pyspark.sql import functions as F

from floorline.functions import tables
from floorline.operators import timeline


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_window_plan_is_the_operators(spark):
    tables.register(spark)
    given = spark.createDataFrame([(i, t) for i, t in enumerate([None, 0, -5, 1, 9_999, 10_000, 10_001, 14_999, 15_000, 15_001, 61_234])], "recording_id long, total_ms long")
    got = spark.sql("SELECT t.recording_id, w.* FROM {t} t, LATERAL window_plan(CAST(t.total_ms AS DOUBLE)) w", t=given)
    assert rows(got) == rows(timeline.window_plan(given)) and got.count() > 20


def test_sub_windows_are_the_operators(spark):
    tables.register(spark)
    given = spark.createDataFrame([(1, i, i * 100, i * 100 + n) for i, n in enumerate([0, 1, 1_999, 2_000, 2_001, 2_499, 2_500, 3_000, 12_345])], "recording_id long, idx long, start_ms long, end_ms long")
    got = spark.sql("SELECT s.recording_id, s.idx, w.* FROM {s} s, LATERAL sub_windows(CAST(s.start_ms AS DOUBLE), CAST(s.end_ms AS DOUBLE), 2000, 1000) w", s=given)
    assert rows(got) == rows(timeline.sub_windows(given, 2000, 1000))


def test_runs_are_the_operators(spark):
    tables.register(spark)
    frames = [(r, f, None if (f * r) % 7 == 3 else (f // 3 * r) % 2) for r in range(5) for f in range(40)]
    given = spark.createDataFrame(frames, "recording_id long, frame long, cls int").withColumns({"start_ms": F.col("frame") * 100, "end_ms": F.col("frame") * 100 + 100}).repartition(6)
    got = spark.sql("SELECT recording_id, cls, start_ms, end_ms, n_frames, idx FROM span_runs(TABLE({f}) PARTITION BY recording_id ORDER BY frame)", f=given)
    assert rows(got) == rows(timeline.merge_runs(given, ["recording_id"], "frame", "cls"))


def test_nothing_and_unknown_times(spark):
    tables.register(spark)
    frames = spark.createDataFrame([(1, 0, 2, None, None), (1, 1, 2, 100, 200), (1, 2, 2, None, 300)], "recording_id long, frame long, cls int, start_ms long, end_ms long")
    ask = "SELECT * FROM span_runs(TABLE({f}) PARTITION BY recording_id ORDER BY frame)"
    assert rows(spark.sql(ask, f=frames)) == [(1, 0, 2, 100, 300, 3)]
    assert rows(spark.sql(ask, f=frames.limit(0))) == []
