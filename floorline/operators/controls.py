"""What control events do to a session: a table of transitions, followed row by row through each session's events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C

#: What each verb does in each phase. A verb of the table that its phase doesn't have is refused; any other is a note.
TRANSITIONS = {
    ("introductions", "next"): "advance",
    ("introductions", "skip"): "begin",
    ("introductions", "add"): "join",
    ("conversation", "next"): "finish",
    ("conversation", "add"): "join",
}
VERBS = {verb for _, verb in TRANSITIONS}


class Phase(NamedTuple):
    """Where a session is: who of how many people is introduced, and how much speech had been heard when that began."""

    phase: str
    person: int | None
    people: int
    since: float = 0.0


def opened(people: int | None) -> Phase:
    """Introductions begin with the first name; without names the conversation does."""
    return Phase("introductions", 0, people) if people else Phase("conversation", None, 0)


def moved(at: Phase, verb: str | None, heard: float, least_ms: float) -> tuple[Phase, bool | None]:
    """The phase after ``verb``, and whether it was taken; null for a note, which changes nothing."""
    if verb not in VERBS:
        return at, None
    match TRANSITIONS.get((at.phase, verb)):
        case "join":
            return Phase(at.phase, at.people, at.people + 1, heard), True
        case "begin":
            return Phase("conversation", None, at.people, heard), True
        case "finish" if at.person is not None:
            return at._replace(person=None), True
        case "advance" if heard - at.since >= least_ms:
            last = at.person + 1 >= at.people
            return Phase("conversation" if last else at.phase, None if last else at.person + 1, at.people, heard), True
    return at, False


def introductions(controls: DataFrame, speech: DataFrame, names: DataFrame, least_ms: float = C.INTRODUCTION_MIN_MS) -> DataFrame:
    """(recording_id, idx, verb, taken, phase, person, people): what each control event did, in order of (at_ms, idx).

    ``controls`` has (recording_id, idx, at_ms, verb), ``speech`` (recording_id, at_ms, ms): what had been heard by then, and
    ``names`` (recording_id, people). ``next`` goes on to the next name once ``least_ms`` of the one before were heard, and after the
    last to the conversation; within that it ends the introduction of someone who joined. ``skip`` goes to the conversation.
    Sessions without a row in ``names`` have nobody. Null ``at_ms`` come first, null ``ms`` count as nothing; speech of a control's
    own time counts. A session's rows stream through one task, which holds its phase alone.
    """
    kind = controls.schema["recording_id"].dataType.simpleString()
    told = controls.select("recording_id", "idx", "at_ms", F.struct("verb").alias("told"), F.lit(0.0).alias("ms"))
    sound = speech.select("recording_id", F.lit(None).cast(controls.schema["idx"].dataType).alias("idx"), "at_ms", F.lit(None).cast(told.schema["told"].dataType).alias("told"), F.coalesce(F.col("ms").cast("double"), F.lit(0.0)).alias("ms"))
    upto = Window.partitionBy("recording_id").orderBy("at_ms").rangeBetween(Window.unboundedPreceding, 0)
    heard = told.unionByName(sound).withColumn("heard", F.sum("ms").over(upto)).where("told is not null")
    people = names.groupBy("recording_id").agg(F.max("people").cast("int").alias("people"))
    rows = heard.join(people, "recording_id", "left").select("recording_id", F.col("idx").cast("long").alias("idx"), "told.verb", "heard", "people", "at_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, begun = None, opened(0), False
        for batch in batches:
            out = []
            for name, verb, ms, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not begun or name != key:
                    key, at, begun = name, opened(n), True
                at, taken = moved(at, verb, ms, least_ms)
                out.append((taken, at.phase, at.person, at.people))
            taken, phase, person, n = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(taken, pa.bool_()), pa.array(phase, pa.string()), pa.array(person, pa.int32()), pa.array(n, pa.int32())], names=["recording_id", "idx", "verb", "taken", "phase", "person", "people"])

    return rows.repartition("recording_id").sortWithinPartitions("recording_id", "at_ms", "idx").mapInArrow(run, f"recording_id {kind}, idx long, verb string, taken boolean, phase string, person int, people int")


def generation_at(rows: DataFrame, fences: DataFrame, at: str, out: str = "generation") -> DataFrame:
    """``rows`` with the greatest ``generation`` of their recording's ``fences`` (recording_id, at_ms, generation) by the time ``at``, a fence at that very time included.

    0 before the first fence and for rows without a time. Both sides meet in one window, so nothing is paired.
    """
    kind = rows.schema[at].dataType
    told = rows.select("recording_id", F.col(at).alias("_at"), F.lit(None).cast("long").alias("_fence"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    marks = fences.where("at_ms is not null").select("recording_id", F.col("at_ms").cast(kind).alias("_at"), F.col("generation").cast("long").alias("_fence"), F.lit(None).cast(told.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("recording_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    known = told.unionByName(marks).withColumn("_by", F.coalesce(F.max("_fence").over(upto), F.lit(0).cast("long")))
    return known.where("_row is not null").select("_row.*", F.col("_by").alias(out))


def in_time(results: DataFrame, fences: DataFrame) -> DataFrame:
    """The ``results`` (recording_id, asked_ms, arrived_ms, ...) that count, with their ``generation``: those asked for and arrived within one.

    A session that recovers begins a generation. What a network was asked before that and answers later is dropped, so a late
    result changes nothing; results that never arrive, with null ``arrived_ms``, are dropped too.
    """
    asked = generation_at(results.where("arrived_ms is not null"), fences, "asked_ms")
    return generation_at(asked, fences, "arrived_ms", "_arrived").where("generation = _arrived").drop("_arrived")
