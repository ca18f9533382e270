"""Table functions for SQL: window plan and sub-windows as expressions that Spark puts into the plan, runs of frames as a fold over a partitioned table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import constants as C

_PLAN = f"""CREATE OR REPLACE TEMPORARY FUNCTION window_plan(total_ms DOUBLE)
RETURNS TABLE(`window` INT, start_ms DOUBLE, end_ms DOUBLE, trust_from_ms DOUBLE, trust_to_ms DOUBLE)
RETURN SELECT i, s[i], least(s[i] + {C.WINDOW_MS}, total_ms), if(i = 0, 0, (s[i] + get(s, i - 1) + {C.WINDOW_MS}) / 2), if(i = size(s) - 1, total_ms, (get(s, i + 1) + s[i] + {C.WINDOW_MS}) / 2)
FROM (SELECT concat(transform(sequence(0, n), x -> CAST(x AS DOUBLE) * {C.HOP_MS}), if(total_ms > {C.WINDOW_MS} AND n * {C.HOP_MS} + {C.WINDOW_MS} < total_ms, array(total_ms - {C.WINDOW_MS}), CAST(array() AS ARRAY<DOUBLE>))) AS s
FROM (SELECT CAST(greatest(floor((total_ms - {C.WINDOW_MS}) / {C.HOP_MS}), 0) AS INT) AS n WHERE total_ms > 0)), LATERAL explode(sequence(0, size(s) - 1)) AS e(i)"""

_PIECES = """CREATE OR REPLACE TEMPORARY FUNCTION sub_windows(from_ms DOUBLE, to_ms DOUBLE, width DOUBLE, hop DOUBLE)
RETURNS TABLE(piece INT, start_ms DOUBLE, end_ms DOUBLE)
RETURN SELECT i, from_ms + i * hop, if(to_ms - from_ms <= width, to_ms, least(from_ms + i * hop + width, to_ms))
FROM explode(sequence(0, if(to_ms - from_ms <= width, 0, CAST(greatest(floor((to_ms - from_ms + hop / 2 - width) / hop), 0) AS INT)))) AS e(i)"""


def _known(pick, a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else pick(a, b)


class Runs:
    """Rows (recording_id, cls, start_ms, end_ms) in order to runs of an equal ``cls``; what is held is the open run. Null is a class; null times are passed over."""

    def __init__(self) -> None:
        self.n_runs, self.run = 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        run = self.run
        if run is not None and run[2] == row["cls"]:
            self.run = (*run[:3], _known(min, run[3], row["start_ms"]), _known(max, run[4], row["end_ms"]), run[5] + 1)
            return
        self.run = (row["recording_id"], self.n_runs, row["cls"], row["start_ms"], row["end_ms"], 1)
        self.n_runs += 1
        if run is not None:
            yield run

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL.

    ``window_plan(total_ms)``: the windows of a recording and their trust regions, none for a null or empty one.
    ``sub_windows(from_ms, to_ms, width, hop)``: the pieces of a span. Both are called laterally and shuffle nothing.
    ``span_runs(TABLE(frames) PARTITION BY recording_id ORDER BY frame)``: neighbouring frames of one class as one row.
    """
    spark.sql(_PLAN)
    spark.sql(_PIECES)
    spark.udtf.register("span_runs", udtf(Runs, returnType="recording_id long, idx int, cls int, start_ms long, end_ms long, n_frames long"))
