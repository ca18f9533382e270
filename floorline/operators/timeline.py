"""Windows, frames and spans on a recording's timeline. All of it is column expressions and window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C


def window_plan(recordings: DataFrame, total: str = "total_ms", size: int = C.WINDOW_MS, hop: int = C.HOP_MS) -> DataFrame:
    """(recording_id, total_ms) to windows with trust regions that tile the time exactly once.

    Windows start every ``hop``; a last one ends with the recording. Neighbours part in the middle of what both cover.
    """
    t = F.col(total).cast("double")
    steps = F.greatest(F.floor((t - size) / hop), F.lit(0)).cast("int")
    regular = F.transform(F.sequence(F.lit(0), steps), lambda i: i.cast("double") * hop)
    tail = F.when((t > size) & (steps * hop + size < t), F.array(t - size)).otherwise(F.array().cast("array<double>"))
    starts = recordings.where(t > 0).select("recording_id", t.alias("total_ms"), F.posexplode(F.concat(regular, tail)).alias("window", "start_ms"))
    near = Window.partitionBy("recording_id").orderBy("window")
    edge = lambda a, b: (a + b + size) / 2
    return starts.select(
        "recording_id",
        "window",
        "start_ms",
        F.least(F.col("start_ms") + size, F.col("total_ms")).alias("end_ms"),
        F.coalesce(edge(F.col("start_ms"), F.lag("start_ms").over(near)), F.lit(0.0)).alias("trust_from_ms"),
        F.coalesce(edge(F.lead("start_ms").over(near), F.col("start_ms")), F.col("total_ms")).alias("trust_to_ms"),
    )


def arg_max(logits: Column) -> Column:
    """Place of the largest value, the first of equals; NaN never wins, and 0 if there is nothing else."""
    clean = F.transform(logits, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))))
    return F.greatest(F.array_position(clean, F.array_max(clean)) - 1, F.lit(0)).cast("int")


def biased(logits: Column, bias: Column) -> Column:
    """Logits with ``bias`` taken off the class of silence."""
    return F.transform(logits, lambda x, i: F.when(i == 0, x - bias).otherwise(x))


def speakers_of(cls: Column) -> Column:
    """Local speakers of a class; none for an unknown one."""
    table = F.array(*(F.array(*(F.lit(s) for s in who)).cast("array<int>") for who in C.POWERSET))
    return F.when(cls.between(0, len(C.POWERSET) - 1), F.element_at(table, cls + 1)).otherwise(F.array().cast("array<int>"))


def merge_runs(frames: DataFrame, keys: list[str], order: str, value: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Neighbouring rows with an equal ``value`` become one, from the first start to the last end."""
    near = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(value).over(near).eqNullSafe(F.col(value)) & (F.row_number().over(near) > 1), 0).otherwise(1)
    runs = frames.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_frames"))
    return merged.withColumn("idx", (F.col("_run") - 1).cast("int")).drop("_run")


def decode_windows(windows: DataFrame, logits: str = "logits", classes: int = C.CLASSES) -> DataFrame:
    """Windows with flat ``logits`` to spans that tile each window; the last one ends where the window does.

    A trailing part of a frame is left out, and so is a window without a whole one. Carries recording_id and window.
    """
    n = F.floor(F.size(logits) / classes).cast("int")
    counted = windows.where(F.size(logits) >= classes).withColumn("_n", n)
    frames = counted.select("recording_id", "window", "start_ms", "end_ms", "trust_from_ms", "trust_to_ms", "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.slice(F.col(logits), i * classes + 1, F.lit(classes)))).alias("frame", "row"))
    width = (F.col("end_ms") - F.col("start_ms")) / F.col("_n")
    timed = frames.select("recording_id", "window", F.col("start_ms").alias("_w0"), F.col("end_ms").alias("_w1"), "trust_from_ms", "trust_to_ms", "frame", speakers_of(arg_max(F.col("row"))).alias("speakers"), (F.col("frame") * width).alias("start_ms"), F.when(F.col("frame") == F.col("_n") - 1, F.col("end_ms") - F.col("start_ms")).otherwise((F.col("frame") + 1) * width).alias("end_ms"))
    return merge_runs(timed, ["recording_id", "window", "_w0", "_w1", "trust_from_ms", "trust_to_ms"], "frame", "speakers").withColumns({"start_ms": F.col("start_ms") + F.col("_w0"), "end_ms": F.col("end_ms") + F.col("_w0")}).drop("_w0", "_w1")


def clip(spans: DataFrame, low: str = "trust_from_ms", high: str = "trust_to_ms") -> DataFrame:
    """Spans cut to [low, high]; what has no length left is dropped."""
    return spans.withColumns({"start_ms": F.greatest("start_ms", low), "end_ms": F.least("end_ms", high)}).where("end_ms > start_ms")


def single_speaker(spans: DataFrame, least_ms: float = C.MIN_SPEECH_MS) -> DataFrame:
    return spans.where((F.size("speakers") == 1) & (F.col("end_ms") - F.col("start_ms") >= least_ms))


def overlapped(spans: DataFrame) -> DataFrame:
    return spans.where(F.size("speakers") > 1)


def silent(spans: DataFrame) -> DataFrame:
    return spans.where(F.size("speakers") == 0)


def foreground(spans: DataFrame, ratio: float = C.LOUDNESS_RATIO, least: int = C.LOUDNESS_MIN_LEVELS) -> DataFrame:
    """Adds ``keep``: at least ``ratio`` of the recording's median level, or too few levels to tell."""
    whole = spans.groupBy("recording_id").agg(F.median("level").alias("_median"), F.count("level").alias("_n"))
    return spans.join(whole, "recording_id").withColumn("keep", (F.col("_n") < least) | (F.col("level") >= F.col("_median") * ratio)).drop("_median", "_n")


def merge_touching(spans: DataFrame, gap_ms: float, keys: list[str] | None = None) -> DataFrame:
    """Spans of ``keys`` less than ``gap_ms`` apart become one."""
    keys = keys or ["recording_id"]
    near = Window.partitionBy(*keys).orderBy("start_ms", "idx")
    fresh = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(near) >= gap_ms).cast("int"), F.lit(1))
    runs = spans.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_spans")).withColumn("idx", (F.col("_run") - 1).cast("int")).drop("_run")


def sub_windows(spans: DataFrame, size: float, hop: float) -> DataFrame:
    """Pieces of ``size`` every ``hop`` within each span, the last cut at its end; a span no longer than one stays whole."""
    length = F.col("end_ms") - F.col("start_ms")
    steps = F.greatest(F.floor((length + hop / 2 - size) / hop), F.lit(0)).cast("int")
    pieces = F.when(length <= size, F.array(F.struct(F.col("start_ms").cast("double").alias("a"), F.col("end_ms").cast("double").alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct((F.col("start_ms") + i * hop).cast("double").alias("a"), F.least(F.col("start_ms") + i * hop + size, F.col("end_ms")).cast("double").alias("b")))
    )
    return spans.select("recording_id", "idx", F.posexplode(pieces).alias("piece", "p")).select("recording_id", "idx", "piece", F.col("p.a").alias("start_ms"), F.col("p.b").alias("end_ms"))


def excerpt(turns: DataFrame, start_s: float, length_s: float) -> DataFrame:
    """Turns within an excerpt, counted from its start, seconds cut to whole ms."""
    begin, stop = F.greatest(F.col("start_s"), F.lit(start_s)), F.least(F.col("end_s"), F.lit(start_s + length_s))
    return turns.where(stop > begin).withColumns({"start_ms": ((begin - start_s) * 1000).cast("long"), "end_ms": ((stop - start_s) * 1000).cast("long")})


def speaking_turns(spans: DataFrame, gap_ms: float = 1_500) -> DataFrame:
    """Turns: spans of one speaker less than ``gap_ms`` apart."""
    return merge_touching(spans, gap_ms, ["recording_id", "speaker"])
