"""What is different about segments whose vector lies nearer to another annotated speaker than to their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.vectors import cosine_distance, nearest_rank
from .reports import UNKNOWN, purity
from .vectors import centre, centroids, nearest

#: What misplaced and well-placed segments are compared on.
FEATURES = ("duration_ms", "purity", "others", "unannotated", "level", "own_distance")
#: Lower bounds of the bins of purity; below the last one is a bin as well.
PURITY_BINS = (0.95, 0.75, 0.5)


def diagnose(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, idx, own, minute, misplaced, nearest, FEATURES): a row a segment with one annotated speaker.

    ``samples`` has start_ms, end_ms, duration_ms, level, vector and ``truth``, the annotated speaker. Segments of nobody ('?'), of
    several ('mixed') or null take part in the mean that vectors are centred by, and in nothing else. Of centroids that are
    equally near the first name counts. A segment without length has no purity, one without a vector is near
    nobody and not misplaced.
    """
    known = centre(samples).where(~F.col("truth").isin(*UNKNOWN))
    centres = centroids(known, ["recording_id", "truth"])
    near = nearest(known, centres, "truth").withColumn("nearest", F.when(F.col("vector").isNotNull(), F.col("nearest"))).join(centres, ["recording_id", "truth"], "left")
    spans = samples.where(~F.col("truth").isin(*UNKNOWN)).select("recording_id", "idx", "start_ms", "end_ms", F.col("truth").alias("speaker"))
    return near.join(purity(spans, turns), ["recording_id", "idx"], "left").select(
        "recording_id", "idx", F.col("truth").alias("own"), F.floor(F.col("start_ms") / 60_000).cast("int").alias("minute"),
        F.coalesce(F.col("nearest") != F.col("truth"), F.lit(False)).alias("misplaced"), "nearest",
        *FEATURES[:5], cosine_distance(F.col("vector"), F.col("centroid")).alias("own_distance"),
    )


def contrast(diagnosis: DataFrame) -> DataFrame:
    """(recording_id, own, segments, misplaced, crowded_misplaced, crowded_placed, and each feature's two upper medians).

    ``<feature>_misplaced`` and ``<feature>_placed`` are null where there is no such segment. Crowded segments have some of another
    speaker in them. A speaker's segments of one recording are hundreds at most, so a median gathers these.
    """
    off, crowded = F.col("misplaced"), F.col("others") > 0
    sides = {"misplaced": off, "placed": ~off}
    lists = [F.collect_list(F.when(on, F.col(f))).alias(f"{f}_{side}") for f in FEATURES for side, on in sides.items()]
    counts = [F.count("*").alias("segments"), F.count_if(off).alias("misplaced"), *(F.count_if(on & crowded).alias(f"crowded_{side}") for side, on in sides.items())]
    met = diagnosis.groupBy("recording_id", "own").agg(*counts, *lists)
    return met.select("recording_id", "own", "segments", "misplaced", "crowded_misplaced", "crowded_placed", *(nearest_rank(F.col(f"{f}_{side}"), 0.5).alias(f"{f}_{side}") for f in FEATURES for side in sides))


def drawn_to(diagnosis: DataFrame) -> DataFrame:
    """(recording_id, own, nearest, segments, minutes): where misplaced segments are drawn to, and the minutes they begin in, in order."""
    return diagnosis.where("misplaced").groupBy("recording_id", "own", "nearest").agg(F.count("*").alias("segments"), F.sort_array(F.collect_list("minute")).alias("minutes"))


def _bin(value: Column, lows: tuple) -> Column:
    """The highest of ``lows`` that the value reaches, else 0."""
    found = F.lit(0.0)
    for low in sorted(lows):
        found = F.when(value >= low, float(low)).otherwise(found)
    return found


def rates(diagnosis: DataFrame) -> DataFrame:
    """(recording_id, measure, least, segments, misplaced): how many are misplaced by purity and by duration, whoever speaks.

    ``least`` is a bin's lower bound. Segments without purity are in no bin of it.
    """
    bins = F.array(*(F.struct(F.lit(name).alias("measure"), F.when(F.col(name).isNotNull(), _bin(F.col(name), lows)).alias("least")) for name, lows in (("purity", PURITY_BINS), ("duration_ms", C.DURATION_BUCKETS_MS))))
    each = diagnosis.select("recording_id", "misplaced", F.explode(bins).alias("b")).where("b.least is not null")
    return each.groupBy("recording_id", "b.measure", "b.least").agg(F.count("*").alias("segments"), F.count_if("misplaced").alias("misplaced"))
