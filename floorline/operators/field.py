"""What a session's export says about itself: distances between its people, other head counts, its log, when identities came up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.vectors import cosine_distance
from . import cluster as c, spread
from .identity import replay_sessions
from .vectors import centre, centroids

#: Fixed value: where the trusted region of the first window ends.
FIRST_TRUST_TO_MS = 7_500


def people_distances(labelled: DataFrame) -> DataFrame:
    """(recording_id, a, b, distance): between the weighted centroids of labels a < b, on centred vectors; -1 is nobody's label."""
    centres = centroids(centre(labelled).where(F.col("label") != C.OTHER_VOICE), ["recording_id", "label"])
    other = centres.select("recording_id", F.col("label").alias("b"), F.col("centroid").alias("_c"))
    met = centres.join(other, "recording_id").where(F.col("label") < F.col("b"))  # a recording has few labels
    return met.select("recording_id", F.col("label").alias("a"), "b", cosine_distance(F.col("centroid"), F.col("_c")).alias("distance"))


def alternatives(labelled: DataFrame, k: int, background: bool = False) -> DataFrame:
    """(recording_id, people, voice, label, samples, ms): what each group consists of if there were one person fewer or more.

    ``label`` is who a sample is shown as, ``voice`` its group under that head count. Both head counts are cut from one tree of
    merges a recording; fewer than two people aren't tried. With ``background`` the groups beyond the head count are
    intruders, with voice -1; without it their samples go to the nearest group.
    """
    kinds = {n: labelled.schema[n].dataType.simpleString() for n in ("recording_id", "label")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, w = c.centred(np.stack(pdf["vector"].to_numpy()).astype(np.float64)), pdf["duration_ms"].to_numpy(np.float64)
        tree, room = c.merge_tree(v), C.INTRUDER_HEADROOM if background else min(C.SPLINTER_MOST, len(v) // C.SPLINTER_EVERY)
        found = []
        for people in (k - 1, k + 1):
            if people >= 2:
                kept = c.busiest(tree.cut(k=people + room), w, people)
                found.append(pd.DataFrame({"recording_id": pdf["recording_id"], "people": people, "voice": kept if background else c.placed(v, kept, w), "label": pdf["label"], "duration_ms": w}))
        return pd.concat(found) if found else pd.DataFrame(columns=["recording_id", "people", "voice", "label", "duration_ms"])

    schema = f"recording_id {kinds['recording_id']}, people int, voice long, label {kinds['label']}, duration_ms double"
    each = spread.by(labelled.where("vector is not null").select("recording_id", "idx", "vector", "duration_ms", "label"), "recording_id").applyInPandas(run, schema)
    return each.groupBy("recording_id", "people", "voice", "label").agg(F.count("*").alias("samples"), F.sum("duration_ms").alias("ms"))


def log_report(log: DataFrame) -> DataFrame:
    """(recording_id, kind, entries, first_at_ms, first_detail): a session's log by kind. Of entries at one time the least detail is first."""
    first = F.min(F.struct("at_ms", "detail"))
    return log.groupBy("recording_id", "kind").agg(F.count("*").alias("entries"), first.alias("_f")).select("recording_id", "kind", "entries", F.col("_f.at_ms").alias("first_at_ms"), F.col("_f.detail").alias("first_detail"))


def appearances(samples: DataFrame, k: int | None, background: bool = False) -> DataFrame:
    """(recording_id, identity, first_ms, heard): when the replayed page first showed each identity.

    ``heard`` counts the final identities that had been heard when the last one came up. Fewer than there are rows: names were
    handed to fragments of one voice.
    """
    shown = replay_sessions(samples, k, background)
    at = F.lit(FIRST_TRUST_TO_MS) + F.col("window") * C.HOP_MS
    each = shown.select("recording_id", at.alias("at"), F.struct("window", "identities").alias("step"), F.explode(F.array_distinct("identities")).alias("identity"))
    first = each.groupBy("recording_id", "identity").agg(F.min("at").cast("long").alias("first_ms"), F.max("step").alias("step"))
    named = F.col("identity") != C.OTHER_VOICE
    # all that is asked of the replay is one row a recording, so that it runs once
    whole = first.groupBy("recording_id").agg(F.max("step")["identities"].alias("_final"), F.max(F.when(named, F.col("first_ms"))).alias("_last"), F.collect_list(F.when(named, F.struct("identity", "first_ms"))).alias("_firsts"))
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("idx")) - 1
    placed = whole.join(samples.select("recording_id", "end_ms", nth.alias("_n")), "recording_id")
    heard = F.size(F.collect_set(F.when(F.col("end_ms") <= F.col("_last"), F.get("_final", F.col("_n"))))).cast("long")
    both = placed.groupBy("recording_id").agg(F.first("_firsts").alias("_firsts"), heard.alias("heard"))
    return both.select("recording_id", F.explode("_firsts").alias("f"), "heard").select("recording_id", "f.identity", "f.first_ms", "heard")
