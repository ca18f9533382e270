"""The batch path: chunks of sound to shares of the floor, a recording's stages as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import audio, constants as C, scalars
from ..models import Models, models
from ..operators import cluster, interval, spread, tally, timeline
from ..operators.cluster import unit
from ..operators.vectors import centre
from ..sources.audio import CHUNK_MS, heard, totals


@dataclass
class Diarization:
    """What a recording comes to: who spoke how long, when, how far to trust it, and what each stage saw."""

    shares: DataFrame
    spans: DataFrame
    quality: DataFrame
    diagnostics: DataFrame
    samples: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Lets go of what was kept for the results, once these have been read."""
        for kept in self.held:
            kept.unpersist()


def _sound_of(pieces: DataFrame, chunks: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Calls ``work`` with each piece (start_ms, end_ms) and its samples; a piece is seconds long, so a group is a few chunks."""
    at = pieces.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_ms") / CHUNK_MS), F.ceil(F.col("end_ms") / CHUNK_MS) - 1)))
    met = at.join(chunks.select("recording_id", "chunk", "script" if "script" in chunks.columns else "samples"), ["recording_id", "chunk"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        first = pdf.iloc[0]
        sound = np.concatenate(list(heard(pdf)))
        zero = int(first["chunk"]) * CHUNK_MS
        sample = lambda ms: int(np.floor((ms - zero) / 1000 * C.SAMPLE_RATE + 0.5))
        return work(first, sound[sample(first["start_ms"]) : sample(first["end_ms"])])

    return spread.by(met, "recording_id", *keys).applyInPandas(run, schema)


def segment(chunks: DataFrame, models_: Models) -> DataFrame:
    """(recording_id, idx, start_ms, end_ms, speakers): spans that tile each recording once."""

    def work(row, sound):
        scores = np.asarray(models_.segment(sound), dtype=np.float32).ravel()
        return pd.DataFrame({"recording_id": [row["recording_id"]], "window": [row["window"]], "start_ms": [row["start_ms"]], "end_ms": [row["end_ms"]], "trust_from_ms": [row["trust_from_ms"]], "trust_to_ms": [row["trust_to_ms"]], "logits": [scores]})

    windows = timeline.window_plan(totals(chunks))
    scored = _sound_of(windows, chunks, ["window"], work, "recording_id string, window int, start_ms double, end_ms double, trust_from_ms double, trust_to_ms double, logits array<float>")
    spans = timeline.clip(timeline.decode_windows(scored))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms", "window", "idx")) - 1
    return spans.withColumn("n", nth.cast("long")).select("recording_id", F.col("n").alias("idx"), "start_ms", "end_ms", "speakers")


def voices(spans: DataFrame, chunks: DataFrame, models_: Models) -> DataFrame:
    """Adds ``level``, the root mean square of each span's sound, and ``vector``, null if it is too short for a frame of features.

    Both come from one pass over the sound, and none goes beyond this stage.
    """

    def work(row, sound):
        features = audio.fbank(sound)
        vector = unit(np.asarray(models_.embed(features), dtype=np.float64)) if len(features) else None
        return pd.DataFrame({"recording_id": [row["recording_id"]], "idx": [row["idx"]], "level": [audio.rms(sound)], "vector": [vector]})

    return spans.join(_sound_of(spans, chunks, ["idx"], work, "recording_id string, idx long, level double, vector array<double>"), ["recording_id", "idx"])


def diarize(chunks: DataFrame, *, models_: Models | None = None, speaker_count: int | None = None, names: list[str] | None = None, calibrated: int | None = None, background_voices: bool = False) -> Diarization:
    """Diarizes every recording of ``chunks`` (recording_id, chunk, start_ms, samples), one second each at 16 kHz, or of scripted ones.

    The head count comes from calibrated profiles, a stated count or names, in this order; without any, groups are
    formed by distance alone. With ``background_voices`` quiet spans are dropped and surplus voices are other people's.
    """
    models_ = models_ or models()
    session = chunks.sparkSession
    hint = session.range(1).select(scalars.resolve_count(F.lit(calibrated), F.lit(speaker_count).cast("double"), F.array(*(F.lit(n) for n in names or [])).cast("array<string>")).alias("h")).first()["h"]
    spans = segment(chunks, models_).persist()
    candidates = voices(timeline.single_speaker(spans), chunks, models_).persist()
    judged = timeline.foreground(candidates) if background_voices else candidates.withColumn("keep", F.lit(True))
    samples = judged.where("keep and vector is not null").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    labels = cluster.label_speakers(samples, k=hint["k"], background=background_voices)
    credited = interval.credit_overlap(samples.select("recording_id", "idx", "start_ms", "end_ms", "duration_ms", "level"), timeline.overlapped(spans))
    labelled = credited.join(labels, ["recording_id", "idx"]).persist()
    owned = interval.asof_before(timeline.overlapped(spans), samples).where("before is not null").select("recording_id", F.col("before.idx").alias("idx"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    spoken = labelled.where(F.col("label") != C.OTHER_VOICE)
    timeline_ = spoken.select("recording_id", "start_ms", "end_ms", F.col("label").alias("speaker")).unionByName(owned.join(spoken, ["recording_id", "idx"]).select("recording_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.col("label").alias("speaker")))
    clear = tally.clarity(centre(samples).join(labels, ["recording_id", "idx"]))
    quality = tally.reliability_of(labelled).join(tally.overlap_flag(labelled), "recording_id").join(clear, "recording_id").withColumn("k", F.lit(hint["k"]).cast("int")).withColumn("k_source", F.lit(hint["source"]))
    marked = spans.join(judged.select("recording_id", "idx", "keep"), ["recording_id", "idx"], "left").withColumn("keep", F.coalesce("keep", F.lit(True)))
    counted = tally.stage_counters(marked).join(timeline.window_plan(totals(chunks)).groupBy("recording_id").agg(F.count("*").alias("windows")), "recording_id")
    diagnostics = counted.join(tally.other_voices(labelled), "recording_id", "left").join(labelled.groupBy("recording_id").agg(F.count("*").alias("embeddings"), F.sum(F.when(F.col("label") != C.OTHER_VOICE, F.col("credited_ms")).otherwise(0)).alias("credited_ms")), "recording_id", "left")
    return Diarization(tally.shares(labelled), timeline_, quality, diagnostics, samples.join(labels, ["recording_id", "idx"]), (spans, candidates, labelled))
