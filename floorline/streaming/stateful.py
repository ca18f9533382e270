"""The live job on state in parts: what a batch writes depends on what is new in it, not on how long a session has been going on.

Samples, levels and introductions only ever grow: each is a list to which a batch appends. Identities and credits change
here and there: each is a map from the sample's number, written where the value is another than before. What is left (clocks,
settings, profiles, the sound not used yet) has a bounded size and is one value. The fold is that of ``live``.
A timer ends a stretch in which nothing comes any more, as a pause does; lists of a session that is over expire.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..models import Models, models
from .live import UPDATES, LiveSession, Sample

#: After this time without an event a session's stretch ends; after this time without one its state is gone.
STRETCH_MS = 30_000
FORGET_MS = 7 * 24 * 3_600_000

_COLUMNS = [c.strip().split(" ")[0] for c in UPDATES.split(",")]
_SAMPLE = "start_ms double, end_ms double, level double, vector binary"


def _sample(row: tuple) -> Sample:
    return Sample(row[0], row[1], row[2], np.frombuffer(row[3], dtype=np.float64))


def _row(s: Sample) -> tuple:
    return float(s.start_ms), float(s.end_ms), float(s.level), np.asarray(s.vector, dtype=np.float64).tobytes()


def rows_of_state(before: tuple, session: LiveSession) -> dict[str, list]:
    """What a batch writes: new entries of the lists, and of the maps those that differ from ``before``.

    ``before`` has the numbers of samples, levels and introductions, the identities and the credits as they were.
    """
    samples, levels, introduced, identities, credits = before
    now = [s.credited_ms for s in session.samples]
    return {
        "samples": [_row(s) for s in session.samples[samples:]],
        "levels": [(float(x),) for x in session.levels[levels:]],
        "introduced": [(int(p), *_row(s)) for p, s in session.introduced[introduced:]],
        "identities": [(i, int(x)) for i, x in enumerate(session.identities) if i >= len(identities) or identities[i] != x],
        "credits": [(i, float(x)) for i, x in enumerate(now) if (credits[i] if i < len(credits) else 0.0) != x],
    }


class LiveProcessor(StatefulProcessor):
    """One session under its key."""

    def __init__(self, nets: Models, options: dict, stretch_ms: int | None):
        self.nets, self.options, self.stretch_ms = nets, options, stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        forget = FORGET_MS if self.stretch_ms else None
        self.handle = handle
        self.core = handle.getValueState("core", "body binary", forget)
        self.lists = {name: handle.getListState(name, schema, forget) for name, schema in (("samples", _SAMPLE), ("levels", "level double"), ("introduced", f"profile int, {_SAMPLE}"))}
        self.maps = {name: handle.getMapState(name, "at long", f"value {kind}", forget) for name, kind in (("identities", "long"), ("credits", "double"))}

    def _load(self) -> tuple[LiveSession | None, tuple]:
        """The session put together, or None if it was disposed of; and what of it was there."""
        if not self.core.exists():
            return LiveSession(**self.options), (0, 0, 0, [], [])
        body = self.core.get()[0]
        if not body:
            return None, ()
        session: LiveSession = pickle.loads(body)
        session.samples = [_sample(r) for r in self.lists["samples"].get()]
        session.levels = [r[0] for r in self.lists["levels"].get()]
        session.introduced = [(r[0], _sample(r[1:])) for r in self.lists["introduced"].get()]
        identities, credits = ({k[0]: v[0] for k, v in self.maps[name].iterator()} for name in ("identities", "credits"))
        session.identities = [identities[i] for i in range(len(identities))]
        for i, ms in credits.items():
            session.samples[i].credited_ms = ms
        return session, (len(session.samples), len(session.levels), len(session.introduced), list(session.identities), [s.credited_ms for s in session.samples])

    def _keep(self, session: LiveSession, before: tuple) -> None:
        if session.disposed:
            for state in (*self.lists.values(), *self.maps.values()):
                state.clear()
            self.core.update((b"",))
            return
        new = rows_of_state(before, session)
        for name, state in self.lists.items():
            if new[name]:
                state.appendList(new[name])
        for name, state in self.maps.items():
            for at, value in new[name]:
                state.updateValue((at,), (value,))
        session.samples, session.levels, session.introduced, session.identities = [], [], [], []
        self.core.update((pickle.dumps(session),))

    def _timer(self, timers) -> None:
        if self.stretch_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.stretch_ms)

    @staticmethod
    def _frame(key: tuple, seq: int, states: list[dict], session: LiveSession) -> list[dict]:
        out = [{"session": key[0], "seq": seq, "events": None} | s for s in states]
        if out:  # the log's new entries go with the next state
            out[-1]["events"] = json.dumps(session.report())
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, before = self._load()
        if session is None:
            return
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.verb is None or row.verb != row.verb:
                found = session.push(np.asarray(row.samples if row.samples is not None else [], dtype=np.float32), self.nets)
            else:
                found = session.control(row.verb, None if pd.isna(row.idx) else int(row.idx), row.name, self.nets)
            out += self._frame(key, row.seq, found, session)
        self._keep(session, before)
        self._timer(timerValues)
        if out:
            yield pd.DataFrame(out)[_COLUMNS].astype({"holder": "Int64", "k": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for long: what sound is left is analysed, and what comes next is a new stretch."""
        session, before = self._load()
        if session is None:
            return
        out = self._frame(key, -1, session.flush(self.nets), session)
        self._keep(session, before)
        if out:
            yield pd.DataFrame(out)[_COLUMNS].astype({"holder": "Int64", "k": "Int64"})

    def close(self) -> None:
        pass


def live_updates_in_parts(events: DataFrame, *, nets: Models | None = None, stretch_ms: int | None = None, **options) -> DataFrame:
    """As ``live.live_updates``, with the same rows, on state in parts. Needs the RocksDB state store.

    With ``stretch_ms``, for jobs that run without end, a session's stretch ends when nothing has come for so long (such rows
    have seq -1), and the state of one that hears nothing for ``FORGET_MS`` is gone.
    """
    processor = LiveProcessor(nets or models(), options, stretch_ms)
    return events.groupBy("session").transformWithStateInPandas(processor, UPDATES, "Update", "ProcessingTime" if stretch_ms else "None")
