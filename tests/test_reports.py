import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.functions import scalars
from floorline.operators import reports as r
from floorline.sources.audio import make_voices


def frame(spark, v, truth, ms=2000.0):
    rows = [("r", i, [float(x) for x in v[i]], i * 3000.0, i * 3000.0 + ms, ms, f"p{t}") for i, t in enumerate(truth)]
    return spark.createDataFrame(rows, "recording_id string, idx long, vector array<double>, start_ms double, end_ms double, duration_ms double, truth string")


def test_scoreboard_on_clear_voices(spark):
    v, truth = make_voices(3, 8)
    got = {x.policy: x for x in r.scoreboard(frame(spark, v, truth), 3).collect()}
    assert set(got) == set(r.POLICIES) and all(x.accuracy == 1.0 and x.groups == 3 for n, x in got.items())


def test_core_of_too_few_falls_back():
    v, truth = make_voices(2, 3)
    assert r.core_first(v, np.full(6, 100.0), 2, 1500).tolist() == truth.tolist()
    assert r.core_first(v, np.array([2000.0, 2000.0, 100, 100, 100, 100]), 2, 1500).tolist() == truth.tolist()


def test_accuracy_and_names():
    truth, labels, w = np.array(["a", "a", "b", "?"], object), np.array([0, 1, 1, 0]), np.array([3.0, 1.0, 2.0, 9.0])
    names = r.best_names(labels, truth, w)
    assert names == {0: "a", 1: "b"} and r.accuracy(labels, truth, w, names) == pytest.approx(5 / 6)
    assert r.enrolled_first(truth, w * 1000, 2).tolist() == [True, False, True, False]


def test_enrolment_and_newcomers():
    v, truth = make_voices(3, 12, dim=66)
    names, starts, w = np.array([f"p{t}" for t in truth], object), np.arange(36) * 3000.0, np.full(36, 2500.0)
    assert all(a == 1.0 for *_, a in r.enrolment(v, starts, w, names))
    for row in r.newcomers(v, starts, w, names, 108_000):
        if row[0] == "near":
            assert row[4:6] == (3, 3) and row[7] == 0


def test_field_and_smoothing(spark):
    v, truth = make_voices(2, 8)
    df = frame(spark, v, truth)
    row = r.field_report(df, 2).first()
    assert (row.samples, row.agree, row.replay_agree, row.identities) == (16, 16, 16, 2)
    assert {x.changed for x in r.smoothing_report(df, 2).where("penalty <= 0.3").collect()} == {0}


def test_locale(spark):
    pick = lambda stored, *tags: spark.range(1).select(scalars.choose_locale(F.lit(stored).cast("string"), F.array(*(F.lit(t) for t in tags)).cast("array<string>"))).first()[0]
    assert pick(None, "fr-FR", "es-MX") == "es" and pick(None) == "en" and pick("en", "es") == "en" and pick("xx", "ES") == "es"
