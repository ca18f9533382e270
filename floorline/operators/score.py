"""How well a result agrees with an annotation: frames, matching, error rates and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C
from .interval import RULES, overlap_join, overlap_owners, speaker_at

#: Width in frames of the bins in which stretches meet the turns over them.
PIECE_FRAMES = 1_000


def _framed(turns: DataFrame, totals: DataFrame | None, frame_ms: int) -> DataFrame:
    """``turns`` with ``start_ms`` and ``end_ms`` as numbers of frames: from the first that they touch to the one after the last."""
    first, last = F.greatest(F.lit(0), F.floor(F.col("start_ms") / frame_ms)), F.ceil(F.col("end_ms") / frame_ms)
    if totals is not None:
        turns, last = turns.join(totals, "recording_id"), F.least(F.ceil(F.col("total_ms") / frame_ms), last)
    return turns.withColumn("_len", F.col("end_ms") - F.col("start_ms")).withColumns({"_from": F.col("start_ms"), "_to": F.col("end_ms"), "start_ms": first, "end_ms": last}).where("end_ms > start_ms")


def _pieces(*framed: DataFrame) -> DataFrame:
    """(recording_id, start_ms, end_ms): the stretches between neighbouring edges of all ``framed`` rows. Within one nothing changes."""
    edges = None
    for t in framed:
        for c in ("start_ms", "end_ms"):
            part = t.select("recording_id", F.col(c).alias("start_ms"))
            edges = part if edges is None else edges.union(part)
    after = F.lead("start_ms").over(Window.partitionBy("recording_id").orderBy("start_ms"))
    return edges.distinct().withColumn("end_ms", after).where("end_ms is not null")


def _over(pieces: DataFrame, framed: DataFrame, value, **more) -> DataFrame:
    """(recording_id, start_ms, end_ms, and aggregates ``value``, ``more``) of the ``framed`` rows, as b_*, that lie over each piece."""
    return overlap_join(pieces, framed, width=PIECE_FRAMES).groupBy("recording_id", "start_ms", "end_ms").agg(value, *(v.alias(k) for k, v in more.items()))


def _winner(name: str):
    return F.max_by("b_speaker", F.struct("b__len", "b_idx")).alias(name)


def rasterise(turns: DataFrame, totals: DataFrame, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(recording_id, frame, frames, speaker): of each frame that turns touch the longest wins, of equals the later.

    Stretches of frames in which nothing changes are one row, that begins with ``frame``; so rows grow with turns, not with time.
    """
    framed = _framed(turns, totals, frame_ms)
    return _over(_pieces(framed), framed, _winner("speaker")).select("recording_id", F.col("start_ms").alias("frame"), (F.col("end_ms") - F.col("start_ms")).alias("frames"), "speaker")


def aligned(reference: DataFrame, hypothesis: DataFrame, totals: DataFrame, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(recording_id, frame, frames, ref, hyp): both rasters side by side, in stretches in which neither changes.

    Frames in which neither speaks have no row.
    """
    a, b = _framed(reference, totals, frame_ms), _framed(hypothesis, totals, frame_ms)
    pieces, keys = _pieces(a, b), ["recording_id", "start_ms", "end_ms"]
    both = _over(pieces, a, _winner("ref")).join(_over(pieces, b, _winner("hyp")), keys, "full")
    return both.select("recording_id", F.col("start_ms").alias("frame"), (F.col("end_ms") - F.col("start_ms")).alias("frames"), "ref", "hyp")


def _greedy(pairs: Column, kind: str) -> Column:
    """Of ``pairs``, an array of structs (minus, hyp, ref, n) of type ``kind``, those that the greedy matching takes: each side used once."""
    free = lambda taken, p, c: ~F.exists(taken, lambda t: t[c] == p[c])
    return F.aggregate(F.array_sort(pairs), F.array().cast(kind), lambda taken, p: F.when(free(taken, p, "hyp") & free(taken, p, "ref"), F.concat(taken, F.array(p))).otherwise(taken))


def _pairs(counts: DataFrame, on: Column) -> tuple[Column, str]:
    """The aggregate that collects the ``counts`` (hyp, ref, n) for which ``on`` holds as such pairs, and its type."""
    pair = F.struct((-F.col("n")).alias("minus"), "hyp", "ref", "n")
    return F.collect_list(F.when(on, pair)), f"array<{counts.select(pair.alias('p')).schema['p'].dataType.simpleString()}>"


def greedy_match(counts: DataFrame) -> DataFrame:
    """(recording_id, hyp, ref, n) to (recording_id, hyp, matched): the largest pair first, each side used once.

    A recording has a handful of speakers; ties go to the pair that names the earlier hypothesis, then reference.
    """
    pairs, kind = _pairs(counts, F.col("hyp").isNotNull() & F.col("ref").isNotNull())
    held = counts.groupBy("recording_id").agg(pairs.alias("pairs"))
    return held.select("recording_id", F.explode(_greedy(F.col("pairs"), kind)).alias("p")).select("recording_id", "p.hyp", F.col("p.ref").alias("matched"))


def match_speakers(frames: DataFrame) -> DataFrame:
    shared = frames.where("ref is not null and hyp is not null").groupBy("recording_id", "hyp", "ref").agg(F.sum("frames").alias("n"))
    return greedy_match(shared)


def error_counters(frames: DataFrame, mapping: DataFrame | None = None, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(recording_id, missed_ms, false_alarm_ms, confusion_ms, correct_ms, reference_ms, der); names stand for themselves without a mapping."""
    named = frames.withColumn("matched", F.col("hyp")) if mapping is None else frames.join(mapping, ["recording_id", "hyp"], "left")
    ref, hyp, same = F.col("ref").isNotNull(), F.col("hyp").isNotNull(), F.coalesce(F.col("matched") == F.col("ref"), F.lit(False))
    count = lambda c: F.sum(F.when(c, F.col("frames")).otherwise(0)) * frame_ms
    sums = named.groupBy("recording_id").agg(count(ref & ~hyp).alias("missed_ms"), count(~ref & hyp).alias("false_alarm_ms"), count(ref & hyp & ~same).alias("confusion_ms"), count(ref & hyp & same).alias("correct_ms"), count(ref).alias("reference_ms"))
    return sums.withColumn("der", F.when(F.col("reference_ms") > 0, (F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")) / F.col("reference_ms")).otherwise(0.0))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, totals: DataFrame) -> DataFrame:
    """Error counters under the greedy mapping of the hypothesis' speakers."""
    text = lambda t: t.withColumn("speaker", F.col("speaker").cast("string"))
    frames = aligned(text(reference), text(hypothesis), totals)
    return error_counters(frames, match_speakers(frames))


def overlap_rule_errors(reference: DataFrame, attributed: DataFrame, overlaps: DataFrame, totals: DataFrame, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(rule, missed_ms, false_alarm_ms, confusion_ms, correct_ms, reference_ms, der): the error rate over all recordings for each
    rule of who gets an overlap. ``attributed`` spans have a ``speaker``; by the rule 'none' nobody gets any.

    All rules share one pass: over each stretch between neighbouring edges the winner of the reference and one by each rule come from
    one aggregate. What is left of a recording is a count by pair of speakers and rule, from which the matching and the counters
    come. Of spans that tie in length and ``idx``, as the halves of an overlap do, the later wins.
    """
    span = lambda t, kind: t.select("recording_id", "idx", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), F.col("speaker").cast("string").alias("speaker"), kind.alias("kind"))
    names = attributed.select("recording_id", F.col("idx").alias("owner"), "speaker")
    given = overlap_owners(overlaps, attributed).join(names, ["recording_id", "owner"])
    rows = span(reference, F.lit("ref")).union(span(attributed, F.lit("all"))).union(span(given, F.col("rule")))
    framed = _framed(rows, totals, frame_ms).select("recording_id", "start_ms", "end_ms", "kind", F.struct("_len", "idx", "_from", "speaker").alias("rank"))
    winner = lambda *kinds: F.max(F.when(F.col("b_kind").isin(*kinds), F.col("b_rank")))["speaker"]
    over = _over(_pieces(framed), framed, winner("ref").alias("ref"), **{f"by_{r}": winner("all", r) for r in RULES})
    each = over.select("recording_id", (F.col("end_ms") - F.col("start_ms")).alias("frames"), "ref", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"by_{r}").alias("hyp")) for r in RULES))).alias("by"))
    counts = each.where("ref is not null or by.hyp is not null").groupBy("recording_id", "by.rule", "by.hyp", "ref").agg(F.sum("frames").alias("n"))
    ref, hyp = F.col("ref").isNotNull(), F.col("hyp").isNotNull()
    pairs, kind = _pairs(counts, ref & hyp)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    held = counts.groupBy("recording_id", "rule").agg(count(~hyp).alias("missed"), count(~ref).alias("false_alarm"), count(ref & hyp).alias("both"), count(ref).alias("reference"), pairs.alias("pairs"))
    correct = F.aggregate(_greedy(F.col("pairs"), kind), F.lit(0).cast("long"), lambda n, p: n + p["n"])
    each_one = held.withColumn("correct", correct).withColumn("confusion", F.col("both") - F.col("correct"))
    sums = each_one.groupBy("rule").agg(*((F.sum(c) * frame_ms).alias(f"{c}_ms") for c in ("missed", "false_alarm", "confusion", "correct", "reference")))
    return sums.withColumn("der", F.when(F.col("reference_ms") > 0, (F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")) / F.col("reference_ms")).otherwise(0.0))


def share_error(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(recording_id, speaker, ms) twice, names matched already, to (recording_id, share_error): half the sum of differences."""
    def part(t: DataFrame, name: str) -> DataFrame:
        whole = F.sum("ms").over(Window.partitionBy("recording_id"))
        return t.groupBy("recording_id", "speaker").agg(F.sum("ms").alias("ms")).select("recording_id", "speaker", F.when(whole > 0, F.col("ms") / whole).otherwise(0.0).alias(name))

    both = part(reference, "a").join(part(hypothesis, "b"), ["recording_id", "speaker"], "full")
    return both.groupBy("recording_id").agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2).alias("share_error"))


def coverage(turns: DataFrame, spans: DataFrame, totals: DataFrame, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(ref_bucket, state, frames): how many are annotated as speaking (0, 1, 2+) against what the system made of it.

    ``spans`` has ``state``: silence, short, attributed, quiet or overlap; of spans that touch a frame the later counts.
    """
    a, b = _framed(turns, totals, frame_ms), _framed(spans, totals, frame_ms)
    pieces, keys = _pieces(a, b), ["recording_id", "start_ms", "end_ms"]
    both = _over(pieces, b, F.max_by("b_state", "b_idx").alias("state")).join(_over(pieces, a, F.count("*").alias("n")), keys, "left")
    return both.groupBy(F.least(F.coalesce("n", F.lit(0)), F.lit(2)).cast("int").alias("ref_bucket"), "state").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("frames"))


def edge_histogram(turns: DataFrame, silence: DataFrame, frame_ms: int = C.DER_FRAME_MS) -> DataFrame:
    """(bucket, frames): silence heard within a single turn, by distance of the frame's middle from the turn's edges."""
    a, b = (_framed(t.where("end_ms > start_ms"), None, frame_ms) for t in (turns, silence))
    pieces, keys = _pieces(a, b), ["recording_id", "start_ms", "end_ms"]
    alone = _over(pieces, a, F.count("*").alias("n"), since=F.min("b__from"), until=F.max("b__to")).where("n = 1")
    heard = alone.join(_over(pieces, b, F.count("*").alias("heard")), keys, "left_semi")

    def at_least(low: int):
        """Frames of a piece whose middle is ``low`` or more from both edges of its turn."""
        first = F.ceil((F.col("since") + low - frame_ms / 2) / frame_ms)
        after = F.floor((F.col("until") - low - frame_ms / 2) / frame_ms) + 1
        return F.greatest(F.lit(0), F.least(F.col("end_ms"), after) - F.greatest(F.col("start_ms"), first))

    whole = [F.col("end_ms") - F.col("start_ms"), *(at_least(low) for low in C.EDGE_BUCKETS_MS[1:]), F.lit(0)]
    counts = F.array(*(F.struct(F.lit(i).alias("bucket"), (x - y).cast("long").alias("n")) for i, (x, y) in enumerate(zip(whole, whole[1:]))))
    return heard.select(F.explode(counts).alias("c")).groupBy("c.bucket").agg(F.sum("c.n").alias("frames")).where("frames > 0")


def switch_latencies(turns: DataFrame, updates: DataFrame, least_ms: int = 2_000, lead_ms: int = 200, grace_ms: int = 5_000) -> DataFrame:
    """(recording_id, idx, latency_ms) of each change of turn: to the first update, by turn's end plus grace, that names the speaker.

    A change is a turn of ``least_ms`` or more, not the first, whose speaker wasn't speaking ``lead_ms`` before it. Null: never.
    """
    order = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms", "idx"))
    later = turns.withColumn("_nth", order).where((F.col("_nth") > 1) & (F.col("end_ms") - F.col("start_ms") >= least_ms))
    asked = later.select("recording_id", "idx", "start_ms", "end_ms", "speaker", (F.col("start_ms") - lead_ms).alias("at_ms"))
    changes = speaker_at(asked, turns).where(~F.col("who").eqNullSafe(F.col("speaker"))).select("recording_id", "idx", "start_ms", (F.col("end_ms") + grace_ms + 1).alias("end_ms"), "speaker")
    points = updates.where("active is not null").select("recording_id", F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 1).alias("end_ms"), "active")
    met = overlap_join(changes, points).where((F.col("b_active") == F.col("speaker")) & (F.col("b_start_ms") >= F.col("start_ms")))
    first = met.groupBy("recording_id", "idx").agg(F.min("b_start_ms").alias("_hit"))
    return changes.join(first, ["recording_id", "idx"], "left").select("recording_id", "idx", (F.col("_hit") - F.col("start_ms")).alias("latency_ms"))


def flips(updates: DataFrame) -> DataFrame:
    """(recording_id, stable, flips): consecutive updates with the same annotated speaker ``who``, and those that changed ``active``."""
    near = Window.partitionBy("recording_id").orderBy("at_ms")
    pair = updates.select("recording_id", "who", "active", F.lag("who").over(near).alias("w0"), F.lag("active").over(near).alias("a0"))
    same = pair.where("w0 = who and a0 is not null and active is not null")
    return same.groupBy("recording_id").agg(F.count("*").alias("stable"), F.count_if(F.col("a0") != F.col("active")).alias("flips"))
