"""From labelled spans to shares per person, and how far to trust them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.scalars import reliability
from ..functions.vectors import cosine_distance, nearest_rank
from .vectors import centroids


def shares(labelled: DataFrame) -> DataFrame:
    """(recording_id, label, duration_ms, credited_ms) to (recording_id, speaker, total_ms, share, segments); -1 isn't shown."""
    own = labelled.where(F.col("label") != C.OTHER_VOICE).groupBy("recording_id", F.col("label").alias("speaker"))
    totals = own.agg(F.sum(F.col("duration_ms") + F.col("credited_ms")).alias("total_ms"), F.count("*").alias("segments"))
    spoken = F.sum("total_ms").over(Window.partitionBy("recording_id"))
    return totals.select("recording_id", "speaker", "total_ms", F.when(spoken > 0, F.col("total_ms") / spoken).otherwise(0.0).alias("share"), "segments")


def ordered(tallied: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """``tallied`` with ``rank``: who spoke most comes first, of equals who was heard first by ``first`` (recording_id, speaker, first_ms)."""
    met = tallied.withColumn("first_ms", F.lit(None).cast("double")) if first is None else tallied.join(first.select("recording_id", "speaker", "first_ms"), ["recording_id", "speaker"], "left")
    order = Window.partitionBy("recording_id").orderBy(F.desc("total_ms"), F.col("first_ms").asc_nulls_last(), "speaker")
    return met.withColumn("rank", F.row_number().over(order)).drop("first_ms")


def other_voices(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("recording_id").agg(F.coalesce(F.sum(F.when(F.col("label") == C.OTHER_VOICE, F.col("duration_ms") + F.col("credited_ms"))), F.lit(0)).alias("other_voices_ms"))


def with_profiles(tallied: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every profile has a row, with nothing said if need be."""
    rows = profiles.select("recording_id", "speaker").join(tallied, ["recording_id", "speaker"], "left")
    return rows.select("recording_id", "speaker", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_ms", "share", "segments")))


def overlap_flag(labelled: DataFrame) -> DataFrame:
    """(recording_id, overlap_share, heavy): credit as a part of all that is shown."""
    on = F.col("label") != C.OTHER_VOICE
    sums = labelled.groupBy("recording_id").agg(F.coalesce(F.sum(F.when(on, F.col("duration_ms"))), F.lit(0)).alias("own"), F.coalesce(F.sum(F.when(on, F.col("credited_ms"))), F.lit(0)).alias("credited"))
    share = F.when(F.col("own") + F.col("credited") > 0, F.col("credited") / (F.col("own") + F.col("credited"))).otherwise(0.0)
    return sums.select("recording_id", share.alias("overlap_share"), (share > C.OVERLAP_LIMIT).alias("heavy"))


def reliability_of(labelled: DataFrame) -> DataFrame:
    """(recording_id, samples, speakers, reliability)."""
    counts = labelled.groupBy("recording_id").agg(F.count("*").alias("samples"), F.count_distinct(F.when(F.col("label") != C.OTHER_VOICE, F.col("label"))).alias("speakers"))
    return counts.withColumn("reliability", reliability(F.col("samples"), F.col("speakers")))


def clarity(labelled: DataFrame) -> DataFrame:
    """(recording_id, spread, clear): the worst person's upper median distance to their own centroid.

    The samples are centred already. People with too few samples don't count; with none left the spread is zero.
    """
    own = labelled.where(F.col("label") != C.OTHER_VOICE)
    far = own.join(centroids(own, ["recording_id", "label"]), ["recording_id", "label"]).withColumn("d", cosine_distance(F.col("vector"), F.col("centroid")))
    each = far.groupBy("recording_id", "label").agg(F.collect_list("d").alias("ds")).where(F.size("ds") >= C.CLARITY_MIN_SAMPLES)
    worst = each.groupBy("recording_id").agg(F.max(nearest_rank(F.col("ds"), 0.5)).alias("spread"))
    spread = F.coalesce("spread", F.lit(0.0))
    return labelled.select("recording_id").distinct().join(worst, "recording_id", "left").select("recording_id", spread.alias("spread"), (spread <= C.CLARITY_LIMIT).alias("clear"))


def stage_counters(spans: DataFrame) -> DataFrame:
    """What each stage saw, one row a recording; ``spans`` has ``keep`` (loud enough) and ``speakers``."""
    n, ms = F.size("speakers"), F.col("end_ms") - F.col("start_ms")
    single, long_ = n == 1, (n == 1) & (ms >= C.MIN_SPEECH_MS)
    usable = long_ & F.col("keep")
    count = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.when(c, ms)), F.lit(0)).alias(name)
    return spans.groupBy("recording_id").agg(
        F.count("*").alias("spans"), count(single, "single_speaker"), count(long_, "long_enough"), count(usable, "foreground"), total(n == 0, "silence_ms"), total(n > 1, "overlap_ms"), total(single, "speech_ms"),
        total(long_ & ~F.col("keep"), "background_ms"), F.max(F.when(single, ms)).alias("longest_ms"), (F.coalesce(F.sum(F.when(single, ms)), F.lit(0)) - F.coalesce(F.sum(F.when(usable, ms)), F.lit(0))).alias("discarded_ms"),
    )


class RunningMedian:
    """The median of numbers as they come: the smaller half in one heap, the larger in another, so a number costs a logarithm of how many there are."""

    def __init__(self) -> None:
        self.low: list[float] = []  # the negatives, so that the largest is first
        self.high: list[float] = []

    def add(self, x: float) -> float:
        """The median with ``x``; of an even number the mean of the middle two."""
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -x))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def running_median(rows: DataFrame, value: str) -> DataFrame:
    """(recording_id, idx, median): the median of ``value`` over a recording's rows up to each, by idx. A null value doesn't count.

    Rows of a recording stream through one task in order and in batches; what it holds are the numbers alone. Before the first
    number the median is null.
    """
    kind = rows.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, median, last, begun = None, RunningMedian(), None, False
        for batch in batches:
            out = []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or name != key:
                    key, median, last, begun = name, RunningMedian(), None, True
                if x is not None:
                    last = median.add(x)
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["recording_id", "idx", "median"])

    narrow = rows.select("recording_id", F.col("idx").cast("long").alias("idx"), F.col(value).cast("double").alias("_x"))
    return narrow.repartition("recording_id").sortWithinPartitions("recording_id", "idx").mapInArrow(run, f"recording_id {kind}, idx long, median double")
