"""Joins in time: as-of, containment and overlap, none of them by comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C


def _asof(left: DataFrame, right: DataFrame, at: Column, then: Column, value: Column, out: str, backward: bool) -> DataFrame:
    """Adds ``out`` to ``left``: ``value`` of the last row of ``right`` with then <= at (or the first with then >= at)."""
    asked = left.select("*", at.alias("_t"), F.lit(1 if backward else -1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    given = right.select("recording_id", then.alias("_t"), F.lit(0).alias("_side"), value.alias("_v"), F.col("idx").alias("_tie"))
    both = asked.withColumn("_tie", F.lit(None).cast("long")).unionByName(given, allowMissingColumns=True)
    near = Window.partitionBy("recording_id")
    order = near.orderBy("_t", "_side", "_tie") if backward else near.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie"))
    seen = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(out, seen).where(F.col("_side") != 0).select(*left.columns, out)


def asof_before(overlaps: DataFrame, attributed: DataFrame, out: str = "before") -> DataFrame:
    """Adds (idx, end_ms) of the last attributed span that ended when the overlap began, give or take a millisecond."""
    return _asof(overlaps, attributed, F.col("start_ms") + C.ASOF_TOLERANCE_MS, F.col("end_ms"), F.struct("idx", "end_ms"), out, True)


def asof_after(overlaps: DataFrame, attributed: DataFrame, out: str = "after") -> DataFrame:
    """Adds (idx, start_ms) of the first attributed span that begins when the overlap ends, give or take a millisecond."""
    return _asof(overlaps, attributed, F.col("end_ms") - C.ASOF_TOLERANCE_MS, F.col("start_ms"), F.struct("idx", "start_ms"), out, False)


def credit_overlap(attributed: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``attributed`` with ``credited_ms``: the overlap that began after each span and before the next."""
    owned = asof_before(overlaps, attributed).where("before is not null")
    credit = owned.groupBy("recording_id", F.col("before.idx").alias("idx")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("credited_ms"))
    return attributed.join(credit, ["recording_id", "idx"], "left").withColumn("credited_ms", F.coalesce("credited_ms", F.lit(0)))


RULES = ("none", "before", "after", "nearer", "split", "within_1s")


def overlap_owners(overlaps: DataFrame, attributed: DataFrame) -> DataFrame:
    """(recording_id, idx, rule, owner, start_ms, end_ms): who gets each overlap, or which half of it, by each rule."""
    both = asof_after(asof_before(overlaps, attributed), attributed)
    p, q, mid = F.col("before"), F.col("after"), (F.col("start_ms") + F.col("end_ms")) / 2
    dp, dq = F.col("start_ms") - p["end_ms"], q["start_ms"] - F.col("end_ms")
    row = lambda rule, owner, a=F.col("start_ms"), b=F.col("end_ms"): F.struct(F.lit(rule).alias("rule"), owner.alias("owner"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    nearer = F.when(p.isNotNull() & (q.isNull() | (dp <= dq)), p["idx"]).otherwise(q["idx"])
    rows = [row("before", p["idx"]), row("after", q["idx"]), row("nearer", nearer), row("split", p["idx"], b=mid), row("split", q["idx"], a=mid), row("within_1s", F.when(dp < 1000, p["idx"]))]
    return both.select("recording_id", "idx", F.explode(F.array(*rows)).alias("r")).where("r.owner is not null").select("recording_id", "idx", "r.rule", "r.owner", F.col("r.a").alias("start_ms"), F.col("r.b").alias("end_ms"))


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlap_join(a: DataFrame, b: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs of rows of one recording whose intervals intersect, b's columns prefixed ``b_``, with ``shared_ms``.

    Both sides are dealt into bins of ``width`` ms and joined on these; a pair is kept in the bin where it begins.
    """
    left = a.withColumn("_bin", _bins(F.col("start_ms"), F.col("end_ms"), width))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("_bin", _bins(F.col("b_start_ms"), F.col("b_end_ms"), width))
    start, stop = F.greatest("start_ms", "b_start_ms"), F.least("end_ms", "b_end_ms")
    met = left.join(right, (F.col("recording_id") == F.col("b_recording_id")) & (left["_bin"] == right["_bin"]) & (stop > start) & (F.floor(start / width) == left["_bin"]))
    return met.withColumn("shared_ms", stop - start).drop("_bin", "b_recording_id")


def majority_speaker(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, idx, truth): whose turn a span mostly is; 'mixed' if a second has over a quarter, '?' if no one half."""
    shared = overlap_join(spans, turns).groupBy("recording_id", "idx", "b_speaker").agg(F.sum("shared_ms").alias("ms"), F.min("b_idx").alias("first"))
    best = shared.groupBy("recording_id", "idx").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("minus"), "first", F.col("b_speaker").alias("who")))), 1, 2).alias("top"))
    length = F.col("end_ms") - F.col("start_ms")
    first, second = -F.col("top")[0]["minus"], F.when(F.size("top") > 1, -F.get("top", F.lit(1))["minus"])
    truth = F.when(F.col("top").isNull(), "?").when(second > 0.25 * length, "mixed").when(first > 0.5 * length, F.col("top")[0]["who"]).otherwise("?")
    return spans.join(best, ["recording_id", "idx"], "left").select("recording_id", "idx", truth.alias("truth"))


def speaker_at(points: DataFrame, turns: DataFrame, at: str = "at_ms", width: int = 10_000) -> DataFrame:
    """Adds ``who``: speaker of the longest turn that covers the point, the first of equals; null if none does."""
    asked = points.withColumn("_point", F.monotonically_increasing_id()).withColumn("_bin", F.floor(F.col(at) / width))  # equal points are points of their own
    given = turns.select(F.col("recording_id").alias("b_recording_id"), F.col("idx").alias("b_idx"), F.col("start_ms").alias("b_start_ms"), F.col("end_ms").alias("b_end_ms"), F.col("speaker").alias("b_speaker")).withColumn("_bin", _bins(F.col("b_start_ms"), F.col("b_end_ms"), width))
    met = asked.join(given, (asked["recording_id"] == F.col("b_recording_id")) & (asked["_bin"] == given["_bin"]) & (F.col("b_start_ms") <= F.col(at)) & (F.col(at) < F.col("b_end_ms")), "left")
    return met.groupBy("_point", *(F.col(c) for c in points.columns)).agg(F.max_by("b_speaker", F.struct(F.col("b_end_ms") - F.col("b_start_ms"), -F.col("b_idx"))).alias("who")).drop("_point")


def period_of(points: DataFrame, periods: DataFrame, at: str = "mid_ms", width: int = 10_000) -> DataFrame:
    """Adds ``period``: the number of the first period [from_ms, to_ms) that holds the point; an open end is null.

    Points and closed periods meet in bins of ``width`` ms. Open periods, of which a recording has one or two, are held to its
    points as they are.
    """
    named = periods.select(F.col("recording_id").alias("b_rec"), F.col("period").alias("b_period"), F.col("from_ms").alias("b_from"), F.col("to_ms").alias("b_to"))
    endless = F.col("b_to").isNull() | (F.col("b_to").cast("double") == float("inf"))
    closed = named.where(~endless & (F.col("b_to") > F.col("b_from"))).withColumn("b_bin", _bins(F.col("b_from"), F.col("b_to"), width))
    open_ = named.where(endless).select(F.col("b_rec").alias("o_rec"), F.col("b_period").alias("o_period"), F.col("b_from").alias("o_from"))
    asked = points.withColumn("_point", F.monotonically_increasing_id()).withColumn("_bin", F.floor(F.col(at) / width))
    met = asked.join(closed, (F.col("recording_id") == F.col("b_rec")) & (F.col("_bin") == F.col("b_bin")) & (F.col("b_from") <= F.col(at)) & (F.col(at) < F.col("b_to")), "left")
    first = met.groupBy("_point", *(F.col(c) for c in points.columns)).agg(F.min("b_period").alias("_closed"))
    both = first.join(open_, (F.col("recording_id") == F.col("o_rec")) & (F.col("o_from") <= F.col(at)), "left")
    return both.groupBy("_point", "_closed", *(F.col(c) for c in points.columns)).agg(F.least("_closed", F.min("o_period")).alias("period")).drop("_point", "_closed")
