"""The live job on state in parts against the fold of one value, and what its batches write."""

from __future__ import annotations

import pickle
import time

import pytest

from floorline.models import models
from floorline.sources.audio import conversation
from floorline.streaming import live, stateful

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    """Streams of this test keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def script(session: str, talk, seconds: float = 2.5) -> list[tuple]:
    sound, step = conversation(talk), int(seconds * 16_000)
    rows = [(session, n, sound[i : i + step].tolist(), None, None, None) for n, i in enumerate(range(0, len(sound), step))]
    return [*rows, (session, len(rows), None, "flush", None, None)]


def run(spark, batches: list[list[tuple]], folder, job) -> list[tuple]:
    """The updates of ``job`` over batches of rows, one file a batch."""
    source = f"{folder}/in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(f"{source}/{n:04d}")
    stream = spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    found: list[tuple] = []
    query = job(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted(found, key=lambda r: (r[0], r[1], r[2]))


def test_same_updates_as_the_fold(rocks, tmp_path):
    """Two sessions, one with introductions and a dispose, over several batches: state in parts gives the rows of state in one."""
    one = script("one", [("A", 6), ("B", 6), ("AB", 3), ("A", 8)])
    two = [("two", 0, None, "introduce", 0, None), *((s, n + 1, *rest) for s, n, *rest in script("two", [("A", 12)])), ("two", 90, None, "dispose", None, None), ("two", 91, one[0][2], None, None, None)]
    batches = [one[:3] + two[:4], one[3:6], one[6:] + two[4:-1], two[-1:]]
    plain = run(rocks, batches, tmp_path / "a", lambda s: live.live_updates(s, speaker_count=2))
    parts = run(rocks, batches, tmp_path / "b", lambda s: stateful.live_updates_in_parts(s, speaker_count=2))
    assert len(plain) >= 4 and [r[1:] for r in parts] == [r[1:] for r in plain]


def test_what_a_batch_writes_does_not_grow():
    """Rows and bytes that a batch writes late in a long session are as many as early in it, while the session grows."""
    nets, session = models(), live.LiveSession(speaker_count=2)
    sound = conversation([("A", 5), ("B", 5)] * 10)
    wrote, before = [], (0, 0, 0, [], [])
    for i in range(0, len(sound), 80_000):
        session.push(sound[i : i + 80_000], nets)
        new = stateful.rows_of_state(before, session)
        wrote.append(len(pickle.dumps(new)))
        before = (len(session.samples), len(session.levels), len(session.introduced), list(session.identities), [s.credited_ms for s in session.samples])
    assert len(session.samples) >= 15
    assert max(wrote[10:]) <= 2 * max(wrote[2:8])


def test_a_timer_ends_an_idle_stretch(rocks, tmp_path):
    """Sound that is too short for a window is analysed when nothing follows."""
    rows = [r for r in script("s", [("A", 6)]) if r[3] is None]
    rocks.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = rocks.readStream.schema(live.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found: list = []
    query = stateful.live_updates_in_parts(stream, stretch_ms=200, speaker_count=2).writeStream.outputMode("update").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
    for _ in range(240):
        if found:
            break
        time.sleep(0.25)
    query.stop()
    assert [(r.session, r.seq) for r in found][:1] == [("s", -1)] and found[0].samples == 1
