import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.sources import capture
from floorline.sources.audio import SAMPLE, conversation
from floorline.streaming import sinks
from floorline.streaming.live import LiveSession, live_updates
from floorline.models import models


def lines(agent: int, n: int, start: int = 0) -> bytes:
    return b"".join(capture.line(f"s{agent}.{i % 3}", i, np.full(40 + i % 7, (i % 100) / 200)) if i % 5 else capture.line(f"s{agent}.{i % 3}", i, verb="note", name="é" * (i % 50)) for i in range(start, start + n))


def seqs(df):
    return sorted((r.session, r.seq) for r in df.select("session", "seq").collect())


def expected(agents: int, n: int):
    return sorted((f"s{a}.{i % 3}", i) for a in range(agents) for i in range(n))


def test_lines_round_trip():
    x = np.linspace(-1, 1, 101).astype(np.float32)
    session, seq, samples, verb, idx, name = capture.parsed(capture.line("a", 3, x).rstrip(b"\n"))
    assert (session, seq, verb, idx, name) == ("a", 3, None, None, None) and np.abs(samples - x).max() < 1 / 32_767
    assert capture.parsed(capture.line("a", 4, verb="introduce", idx=2, name="x\ny").rstrip(b"\n"))[3:] == ("introduce", 2, "x\ny")
    for bad in (b"", b"{", b"[1]", b'{"session": "a"}', b'{"session": "a", "seq": "x"}', b'{"session": "a", "seq": 1, "pcm": "?"}', b"\xff"):
        assert capture.parsed(bad)[:4] == (None, None, None, "broken")


@pytest.mark.parametrize("piece", [1, 7, 50, 1000])
def test_pieces_hold_each_line_once(piece):
    body = b"".join(b"x" * (i * 7 % 40) + b"\n" for i in range(60))
    for start in (0, body.index(b"\n", 100) + 1):
        pieces = [capture.Piece("f", a, min(a + piece, len(body)), a == start) for a in range(start, len(body), piece)]
        assert [t for p in pieces for t in capture._lines(io.BytesIO(body), p)] == body[start:].split(b"\n")[:-1]


def test_only_whole_lines_are_let_in(monkeypatch):
    monkeypatch.setattr(capture, "STEP_BYTES", 5)
    body = io.BytesIO(b"ab\ncdefghijklmnop\nqr")
    assert [capture.complete_to(body, 0, n) for n in (1, 2, 3, 9, 18, 20)] == [3, 3, 3, 3, 18, 18]
    assert capture.complete_to(body, 3, 5) == 18 and capture.complete_to(body, 18, 20) == 18


def test_restart_goes_on_where_it_was(spark, tmp_path):
    """Agents write between and during runs, lines are cut in the middle, a batch takes few bytes: each line comes once."""
    folder = tmp_path / "in"
    folder.mkdir()
    whole = [lines(a, 90) for a in range(2)]
    cuts = [0, 1500, 1507, 6000, None]

    def run(limit):
        rows = capture.captured(spark, str(folder), cursor=str(tmp_path / "cursor"), max_bytes_per_file=limit)
        query = sinks.write_epochs(rows, str(tmp_path / "out"), str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"})
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        for a, body in enumerate(whole):
            with open(folder / f"{a}{capture.SUFFIX}", "ab") as f:
                f.write(body[low:high])
        run(2000)
    found = sinks.read_epochs(spark, str(tmp_path / "out"), capture.SCHEMA).cache()
    assert seqs(found) == expected(2, 90)
    most = max(r.n for r in found.groupBy("epoch").agg(F.sum(F.length(F.coalesce(F.col("name"), F.lit(""))) + F.size("samples")).alias("n")).collect())
    assert found.select("epoch").distinct().count() > 6 and most < 4000  # what a batch takes in is bounded, after restarts too
    assert json.loads((tmp_path / "cursor").read_text()) == {f"{a}.capture": len(b) for a, b in enumerate(whole)}


def test_a_failing_batch_leaves_nothing(spark, tmp_path):
    folder, out, broken = tmp_path / "in", tmp_path / "out", tmp_path / "broken"
    folder.mkdir()
    broken.touch()
    (folder / f"0{capture.SUFFIX}").write_bytes(lines(0, 60))
    (folder / f"1{capture.SUFFIX}").write_bytes(lines(1, 60))
    flag = str(broken)

    def fail(batches):
        for pdf in batches:
            if os.path.exists(flag) and (pdf["session"].str.startswith("s1") & (pdf["seq"] > 40)).any():
                raise ValueError("lost")
            yield pdf

    def run():
        rows = capture.captured(spark, str(folder)).mapInPandas(fail, capture.SCHEMA)
        query = sinks.write_epochs(rows, str(out), str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"})
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        run()
    assert not list(out.glob("epochs/*.json"))
    broken.unlink()
    run()
    assert seqs(sinks.read_epochs(spark, str(out), capture.SCHEMA)) == expected(2, 60)


def test_an_epoch_committed_again_counts_once(spark, tmp_path):
    import pyarrow as pa

    writer, batch = sinks.EpochWriter(str(tmp_path)), pa.RecordBatch.from_pydict({"x": pa.array([1, 2], pa.int64())})
    first = writer.write(iter([batch]))
    writer.commit([first, sinks.Part(None), None], 0)
    writer.write(iter([batch]))  # of a task that was killed
    writer.commit([writer.write(iter([batch, batch]))], 0)
    lost = writer.write(iter([batch]))
    writer.abort([lost, None], 1)
    got = sinks.read_epochs(spark, str(tmp_path), "x bigint")
    assert sorted((r.epoch, r.x) for r in got.collect()) == [(0, 1), (0, 1), (0, 2), (0, 2)]
    (tmp_path / "parts" / "folder").mkdir()
    sinks._put_in_place(str(tmp_path), 0, ["folder"])
    sinks._put_in_place(str(tmp_path), 0, [])
    assert not (tmp_path / "parts" / "folder").exists() and not sinks.read_epochs(spark, str(tmp_path), "x bigint").collect()
    assert not (tmp_path / "parts" / first.file).exists() and not (tmp_path / "parts" / lost.file).exists()


def test_captured_sound_is_heard_as_the_fold_hears_it(spark, tmp_path):
    sound, nets, session = conversation(SAMPLE), models(), LiveSession(speaker_count=3)
    body, states = b"", []
    for i in range(0, len(sound), 16_000):
        text = capture.line("one", i // 16_000, sound[i : i + 16_000])
        body += text
        states += session.push(capture.parsed(text)[2], nets)
    states += session.control("flush", None, None, nets)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"a{capture.SUFFIX}").write_bytes(body + capture.line("one", 10_000, verb="flush"))
    rows = live_updates(capture.captured(spark, str(tmp_path / "in")).where("session is not null"), speaker_count=3)
    sinks.write_epochs(rows, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination(120)
    last = sinks.latest(sinks.read_epochs(spark, str(tmp_path / "out"), rows.schema)).first()
    assert last.covered_to_ms == states[-1]["covered_to_ms"] and last.total_ms == pytest.approx(states[-1]["total_ms"])
