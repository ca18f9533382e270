import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.functions import audio
from floorline.models import Models, SpreadEmbedder, ToneSegmenter, models, verified
from floorline.plans.diarize import diarize
from floorline.sources import audio as sound, documents
from floorline.streaming import sinks
from floorline.streaming.live import LiveSession, live_updates

TALK = sound.conversation([("A", 4), ("-", 1), ("B", 3), ("-", 0.5), ("A", 6.5), ("B", 2), ("-", 1), ("A", 3), ("B", 4), ("-", 2), ("A", 8), ("B", 5)])
OVERLAP = sound.conversation([("A", 5), ("B", 5), ("A", 3), ("AB", 12), ("B", 5), ("A", 3), ("AB", 8)])


def live(talk, session=None, nets=None, **options):
    session, nets = session or LiveSession(**options), nets or models()
    for i in range(0, len(talk), 16000):
        session.push(talk[i : i + 16000], nets)
    session.flush(nets)
    return session


def test_features():
    f = audio.fbank(sound.test_signal(3, 16000))
    assert f.shape == (98, 80) and np.allclose(f.mean(axis=0), 0, atol=1e-4)
    assert audio.fbank(np.zeros(399)).shape == (0, 80)
    w = audio.mel_weights()
    assert w.shape == (257, 80) and w.max() <= 1 and (w.sum(axis=0) > 0).all()
    assert audio.rms([]) == 0 and audio.rms([3, 4]) == pytest.approx(np.sqrt(12.5))


def test_wav_round_trip(spark, tmp_path):
    (tmp_path / "talk.wav").write_bytes(sound.encode_wav(TALK[:40000]))
    rows = sound.read_wavs(spark, str(tmp_path)).orderBy("chunk").collect()
    assert [len(r.samples) for r in rows] == [16000, 16000, 8000]
    assert np.abs(np.concatenate([r.samples for r in rows]) - TALK[:40000]).max() < 1e-3
    assert len(audio.to_16k_mono(np.zeros((8000, 2)), 8000)) == 16000


def test_batch_equals_stream(spark):
    found = diarize(sound.recordings(spark, {"talk": TALK, "crowd": OVERLAP}), speaker_count=2)
    shares = {}
    for r in found.shares.collect():
        shares.setdefault(r.recording_id, []).append(r.total_ms)
    counts = {r.recording_id: r for r in found.diagnostics.collect()}
    for name, talk in (("talk", TALK), ("crowd", OVERLAP)):
        state = live(talk, speaker_count=2).state()
        assert sorted(state["total_ms"]) == pytest.approx(sorted(shares[name]), abs=20 if name == "talk" else 400)
        assert state["covered_to_ms"] == len(talk) / 16
        assert abs(state["samples"] - counts[name].embeddings) <= 1
    quality = {r.recording_id: r for r in found.quality.collect()}
    assert quality["talk"].reliability == "good" and quality["talk"].clear and not quality["talk"].heavy
    assert quality["crowd"].overlap_share > 0.3 and quality["crowd"].heavy
    assert counts["talk"].windows == 7 and counts["crowd"].overlap_ms > 15_000


def test_background_voices(spark):
    quiet = sound.conversation([("A", 5), ("-", 1), ("B", 5), ("-", 1), ("A", 4), ("-", 1), ("B", 4), ("-", 1), ("C", 4, 0.2), ("-", 1), ("A", 4)])
    found = diarize(sound.recordings(spark, {"r": quiet}), speaker_count=2, background_voices=True)
    assert found.diagnostics.first().background_ms > 2000
    assert diarize(sound.recordings(spark, {"r": quiet}), speaker_count=2).diagnostics.first().background_ms == 0
    assert live(quiet, speaker_count=2, background_voices=True).background_ms > 2000


def test_identities_stay(spark):
    s = live(sound.conversation([("A", 8), ("B", 2), ("A", 4), ("B", 16), ("A", 4), ("-", 1), ("A", 4)]), speaker_count=2)
    assert set(s.identities) == {0, 1} and s.identities[0] == 0


def test_pause_and_resume():
    s = live(sound.conversation([("A", 6), ("-", 1), ("B", 5), ("-", 1), ("A", 4)]), speaker_count=2)
    before = s.state()
    live(sound.conversation([("B", 6), ("-", 1), ("A", 5), ("-", 1), ("B", 4)]), s)
    after = s.state()
    assert after["elapsed_ms"] == 34000 and len(after["speakers"]) == 2 and sum(after["total_ms"]) > sum(before["total_ms"])


def test_introductions():
    s, nets = LiveSession(names=["Ilse", "Bea"], introductions=True), models()
    s.introduce(0)
    for verb, talk in (("introduce", [("A", 12)]), ("start", [("B", 12)])):
        x = sound.conversation(talk)
        for i in range(0, len(x), 16000):
            s.push(x[i : i + 16000], nets)
        s.flush(nets)
        s.introduce(1) if verb == "introduce" else s.start_conversation()
    assert s.profile_mode and s.k == 2 and s.phase == "conversation" and not s.samples
    live(sound.conversation([("B", 8), ("A", 8)]), s)
    assert s.identities[0] == 1 and 0 in s.identities
    assert s.state()["speakers"] == [0, 1]
    assert s.add_person("Cai") == 2 and s.k == 3
    s.introduce(9)
    assert s.periods[-1][0] == 1


def test_failing_window_is_skipped_and_counts_once():
    calls = {"n": 0}

    class Flaky(ToneSegmenter):
        def __call__(self, x):
            calls["n"] += 1
            if calls["n"] in (2, 3, 4) or calls["n"] == 6:
                raise RuntimeError("no")
            return super().__call__(x)

    s = live(TALK, nets=Models(Flaky(), SpreadEmbedder()), speaker_count=2)
    kinds = [k for k, *_ in s.log]
    assert kinds.count("error") == 4 and kinds.count("skipped") == 1
    assert len(s.levels) == len(s.samples)


def test_shedding_and_recovery():
    s = LiveSession()
    s.buffer = np.zeros(16000 * 125, np.float32)
    s.elapsed_ms = 125_000
    s.push(np.zeros(16000, np.float32), models())
    assert [k for k, *_ in s.log].count("dropped") == 1 and s.stretch_from_ms >= 6000
    s.buffer = np.zeros(16000 * 30, np.float32)
    s.recover(models())
    assert s.heard_to_ms - s.trusted_to_ms <= 10_000 and "recovered" in [k for k, *_ in s.log]


def test_export_round_trip(spark, tmp_path):
    s = live(TALK, speaker_count=2, names=["Ilse", "Bea"])
    body = s.export()
    assert "Ilse" not in json.dumps(body)
    (tmp_path / "one.json").write_text(json.dumps(body))
    exports = documents.read_exports(spark, str(tmp_path))
    rows = documents.export_samples(exports).orderBy("idx").collect()
    assert exports.first().known and exports.first().capture is None and len(rows) == len(s.samples)
    assert [r.identity for r in rows] == s.identities and rows[0].vector == pytest.approx(s.samples[0].vector, abs=1e-4)
    assert documents.export_log(exports).where("kind = 'window'").count() >= 7
    again = documents.session_export(documents.export_samples(exports), spark.createDataFrame([("one", 2)], "recording_id string, speakerCount int"))
    again.write.json(str(tmp_path / "out"))
    assert [r.level for r in documents.export_samples(documents.read_exports(spark, str(tmp_path / "out"))).orderBy("idx").collect()] == [r.level for r in rows]


def test_truth_and_dumps(spark, tmp_path):
    turns = spark.createDataFrame([("r", 0, 0.0, 1000.0, "B"), ("r", 1, 500.0, 2000.0, "A")], "recording_id string, idx long, start_ms double, end_ms double, speaker string")
    doc = documents.truth_documents(turns).first()
    assert doc.speakers == ["A", "B"] and doc.turns[0].speaker == "B"
    (tmp_path / "r.truth.json").write_text(json.dumps({"turns": [t.asDict() for t in doc.turns]}))
    assert sorted(map(tuple, documents.read_truth(spark, str(tmp_path / "r.truth.json")).collect())) == sorted(map(tuple, turns.collect()))
    samples = turns.select("recording_id", F.lit(2).alias("people"), F.lit(2000.0).alias("total_ms"), "idx", "start_ms", "end_ms", F.col("speaker").alias("truth"), F.lit(0).alias("label"), F.array(F.lit(1.0)).alias("vector"))
    documents.write_dumps(samples, str(tmp_path / "dumps"))
    back = documents.dump_samples(documents.read_dumps(spark, str(tmp_path / "dumps"), "*.json"))
    assert sorted((r.idx, r.truth, r.duration_ms) for r in back.collect()) == [(0, "B", 1000.0), (1, "A", 1500.0)]


def test_streaming_job_equals_fold(spark, tmp_path):
    chunks = [(n, i // 16000, [float(v) for v in x[i : i + 16000]], None, None, None) for n, x in (("one", TALK), ("two", OVERLAP)) for i in range(0, len(x), 16000)]
    chunks += [(n, 10_000, None, "flush", None, None) for n in ("one", "two")]
    schema = "session string, seq long, samples array<float>, verb string, idx int, name string"
    source = tmp_path / "in"
    ordered = sorted(chunks, key=lambda c: c[1])
    for part, rows in enumerate((ordered[:40], ordered[40:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = live_updates(stream, speaker_count=2)
    query = sinks.write_states(out, str(tmp_path / "states"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    states = spark.read.parquet(str(tmp_path / "states"))
    assert states.select("epoch").distinct().count() == 2
    last = {r.session: r for r in sinks.latest(states).collect()}
    assert sinks.event_log(states).where("kind = 'window' and session = 'one'").count() == 8
    for name, talk in (("one", TALK), ("two", OVERLAP)):
        state = live(talk, speaker_count=2).state()
        assert last[name].total_ms == pytest.approx(state["total_ms"]) and last[name].covered_to_ms == state["covered_to_ms"]


def test_a_session_that_was_disposed_of_stays_so(spark, tmp_path):
    sound = [[float(v) for v in TALK[i : i + 16000]] for i in range(0, 16000 * 12, 16000)]
    rows = [("a", i, s, None, None, None) for i, s in enumerate(sound)] + [("a", 100, None, "dispose", None, None)]
    later = [("a", 200 + i, s, None, None, None) for i, s in enumerate(sound)] + [("b", i, s, None, None, None) for i, s in enumerate(sound)]
    schema = "session string, seq long, samples array<float>, verb string, idx int, name string"
    for part, some in enumerate((rows, later)):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = sinks.write_states(live_updates(stream, speaker_count=2), str(tmp_path / "states"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    states = spark.read.parquet(str(tmp_path / "states"))
    assert {r.session for r in states.where("seq < 100").select("session").collect()} == {"a", "b"}
    assert states.where("session = 'a' and seq >= 100").count() == 0


def test_models(tmp_path):
    with pytest.raises(ValueError):
        models("int8")
    (tmp_path / "m").write_bytes(b"abc")
    assert verified(str(tmp_path / "m"), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3)
    with pytest.raises(ValueError):
        verified(str(tmp_path / "m"), None, 4)


def test_formats_and_the_sample(spark, tmp_path, monkeypatch):
    from floorline.sources import audio

    wav = audio.encode_wav(TALK[:16000])
    assert audio.decode(wav)[1] == 16_000 and len(audio.decode(wav)[0]) == 16_000
    monkeypatch.setattr(audio.shutil, "which", lambda name: None)
    with pytest.raises(ValueError, match="ffmpeg"):
        audio.decode(b"OggS" + wav)
    fake = tmp_path / "ffmpeg"
    fake.write_text("#!/bin/sh\ncat > /dev/null\nprintf '\\000\\000\\200\\077'\n")
    fake.chmod(0o755)
    monkeypatch.setattr(audio.shutil, "which", lambda name: str(fake))
    assert audio.decode(b"OggS")[0].tolist() == [[1.0]]
    sample = audio.sample_recording(spark)
    seconds = sum(t[1] for t in audio.SAMPLE)
    assert audio.totals(sample).first().total_ms == seconds * 1000 and len({v for t in audio.SAMPLE for v in t[0]} - {"-"}) == audio.SAMPLE_COUNT
    stream = audio.live_source(spark, str(tmp_path / "demo"), demo=True)
    assert stream.isStreaming and spark.read.parquet(str(tmp_path / "demo")).count() == sample.count()


def test_progress(spark):
    from floorline.plans.progress import Progress

    said = []
    with Progress(spark, lambda done, total: said.append((done, total)), seconds=0.01):
        spark.range(0, 4_000_000, numPartitions=8).selectExpr("sum(hash(id))").collect()
    assert said and said[-1][0] == said[-1][1] and all(0 <= a <= b for a, b in said)


def test_turns_are_said_by_test_voices(spark):
    """Turns of a table as sound: the session and the batch path hear who spoke, and for how long."""
    from floorline.plans.diarize import diarize
    from floorline.sources.audio import conversation, spoken
    from floorline.streaming.live import replay_states

    turns = [(7, 1, 6000, 12000, "b"), (7, 0, 0, 6000, "a"), (7, 2, 12000, 20000, "a"), (7, 3, 20000, None, "a"), (8, 0, 0, 5000, None), (8, 1, 5000, 17000, "b")]
    table = spark.createDataFrame(turns, "recording_id long, idx long, start_ms long, end_ms long, speaker string")
    chunks = spoken(table, {"a": "A", "b": "B"})
    sound = {k: np.concatenate([np.array(r.samples, np.float32) for r in sorted(chunks.where(f"recording_id = '{k}'").collect(), key=lambda r: r.chunk)]) for k in ("7", "8")}
    assert np.array_equal(sound["7"], conversation([("A", 6), ("B", 6), ("A", 8)])) and len(sound["8"]) == 17 * 16_000
    live = {r.session: r for r in replay_states(chunks, speaker_count=2).collect()}
    assert live["7"].speakers == [0, 1] and live["7"].shares == pytest.approx([0.7, 0.3], abs=0.05)
    assert sum(live["8"].total_ms) == pytest.approx(12_000, rel=0.1)  # stand-in networks are coarse at edges
    shares = {(r.recording_id, r.speaker): r.share for r in diarize(chunks, speaker_count=2).shares.collect()}
    assert shares["7", 0] == pytest.approx(0.7, abs=0.05) and shares["7", 1] == pytest.approx(0.3, abs=0.05)


def test_scripted_sound_is_made_in_many_tasks(spark):
    """Chunks that hold what is to be said instead of samples: they sound alike, and few bytes don't put all of them into one task."""
    from floorline.plans.diarize import diarize, segment, voices
    from floorline.models import models
    from floorline.operators.timeline import single_speaker
    from floorline.sources.audio import heard, scripted, spoken, totals

    turns = [(r, i, 4100 * i, 4100 * (i + 1), "ab"[i % 2]) for r in range(24) for i in range(3)]
    table, said = spark.createDataFrame(turns, "recording_id long, idx long, start_ms long, end_ms long, speaker string"), {"a": "A", "b": "B"}
    scripts, sound = scripted(table, said), spoken(table, said)
    made = {(r, c): s for r, c, s in zip(*(scripts.toPandas()[k] for k in ("recording_id", "chunk")), heard(scripts.toPandas()))}
    assert len(made) == 24 * 13 and all(np.array_equal(np.array(r.samples, np.float32), made[r.recording_id, r.chunk]) for r in sound.collect())
    assert {r.total_ms for r in totals(scripts).collect()} == {12_300.0} == {r.total_ms for r in totals(sound).collect()}
    a, b = (sorted(map(tuple, diarize(c, speaker_count=2).shares.collect())) for c in (scripts, sound))
    assert a == b and len(a) == 48
    found = voices(single_speaker(segment(scripts, models()).limit(1_000)), scripts, models())
    assert found.select("recording_id").distinct().count() == 24
    tasks = lambda t: t.select(F.spark_partition_id()).distinct().count()
    from floorline.operators.cluster import agglomerative

    few = spark.createDataFrame([(r, i, [1.0, float(i)], 1.0) for r in range(24) for i in range(2)], "recording_id long, idx long, vector array<double>, duration_ms double")
    assert tasks(agglomerative(few, k=1)) > 1


def test_replayed_sessions_are_dealt_over_tasks(spark):
    from floorline.sources.audio import scripted
    from floorline.streaming.live import replay_states

    turns = spark.createDataFrame([(r, 0, 0, 3_000, "a") for r in range(24)], "recording_id long, idx long, start_ms long, end_ms long, speaker string")
    found = replay_states(scripted(turns, {"a": "A"}), speaker_count=2).select("elapsed_ms", F.spark_partition_id().alias("task")).collect()
    assert [r.elapsed_ms for r in found] == [3_000.0] * 24 and len({r.task for r in found}) > 1
