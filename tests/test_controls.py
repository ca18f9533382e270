import pytest

from floorline.operators import controls

COLUMNS = "recording_id long, idx long, at_ms long, verb string"


def walked(spark, told, speech, people):
    rows = controls.introductions(
        spark.createDataFrame(told, COLUMNS), spark.createDataFrame(speech, "recording_id long, at_ms long, ms long"), spark.createDataFrame(people, "recording_id long, people int")
    ).collect()
    return {(r.recording_id, r.idx): (r.taken, r.phase, r.person, r.people) for r in rows}


@pytest.mark.parametrize("batch", [1, 100])
def test_names_follow_each_other(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    told = [(1, 0, 4_000, "next"), (1, 1, 6_000, "next"), (1, 2, 9_000, "next"), (1, 3, 12_000, "muted"), (1, 4, 12_000, "next"), (1, 5, 13_000, "next"), (1, 6, 13_500, "skip"), (1, 7, 14_000, "add"), (1, 8, 14_001, "next"), (1, 9, 15_000, None)]
    told += [(2, 0, 10, "skip"), (2, 1, 20, "next"), (3, 0, 5, "add"), (3, 1, 6, "next"), (3, 2, None, "next"), (4, 0, 5, "add"), (4, 1, 9_000, "next")]
    speech = [(1, 4_000, 4_000), (1, 6_000, 1_000), (1, 9_000, 3_000), (1, 12_000, 2_000), (1, None, None), (4, 8_000, 5_000)]
    try:
        got = walked(spark, told, speech, [(1, 2), (2, 3), (4, 2)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    talk, intro = "conversation", "introductions"
    assert got == {
        (1, 0): (False, intro, 0, 2),  # 4 s aren't enough
        (1, 1): (True, intro, 1, 2),
        (1, 2): (False, intro, 1, 2),  # heard anew for the second
        (1, 3): (None, intro, 1, 2),
        (1, 4): (True, talk, None, 2),  # after the last
        (1, 5): (False, talk, None, 2),
        (1, 6): (False, talk, None, 2),
        (1, 7): (True, talk, 2, 3),
        (1, 8): (True, talk, None, 3),  # who joined may be ended at any time
        (1, 9): (None, talk, None, 3),
        (2, 0): (True, talk, None, 3),
        (2, 1): (False, talk, None, 3),
        (3, 2): (False, talk, None, 0),  # no time comes first, nobody is named
        (3, 0): (True, talk, 0, 1),
        (3, 1): (True, talk, None, 1),
        (4, 0): (True, intro, 2, 3),
        (4, 1): (True, talk, None, 3),
    }


def test_no_events(spark):
    assert walked(spark, [], [(1, 5, 5)], [(1, 2)]) == {}


def test_late_results_are_dropped(spark):
    asked = [(1, 0, 10, 20), (1, 1, 10, 50), (1, 2, 50, 60), (1, 3, 55, 90), (1, 4, 95, None), (1, 4, 70, 80), (1, 4, 70, 80), (2, 0, 10, 99), (None, 0, 5, 6)]
    results = spark.createDataFrame(asked, "recording_id long, idx long, asked_ms long, arrived_ms long")
    fences = spark.createDataFrame([(1, 50, 1), (1, 90, 2), (1, None, 9)], "recording_id long, at_ms long, generation long")
    got = sorted(((r.recording_id, r.idx, r.generation) for r in controls.in_time(results, fences).collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 2, 1), (1, 4, 1), (1, 4, 1), (2, 0, 0), (None, 0, 0)], key=str)
    assert controls.in_time(results, fences.limit(0)).count() == 8 and controls.in_time(results.limit(0), fences).count() == 0
