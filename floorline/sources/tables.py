"""The engine's relations, made from general tables by fixed rules; all times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import constants as C
from ..operators.timeline import speakers_of

#: Which class of frame an event stands for.
EVENT_CLASSES = {"signup": 0, "click": 1, "view": 2, "purchase": 3, "error": 4}
#: Samples of a recording made from the embeddings.
SAMPLES_PER_RECORDING = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _starts(keys: str, order: str, length: str = "dur") -> Column:
    return F.coalesce(F.sum(length).over(Window.partitionBy(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans that tile each user's time: (recording_id, idx, cls, speakers, start_ms, end_ms, level)."""
    e = table(spark, sf_dir, "events")
    cls = F.lit(4)
    for name, value in EVENT_CLASSES.items():
        cls = F.when(F.col("event_type") == name, value).otherwise(cls)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select(F.col("user_id").alias("recording_id"), nth.cast("long").alias("idx"), cls.cast("int").alias("cls"), (200 + F.floor(F.col("value") * 10)).cast("long").alias("dur"), F.col("value").alias("level"))
    return rows.withColumn("start_ms", _starts("recording_id", "idx")).select("recording_id", "idx", "cls", speakers_of(F.col("cls")).alias("speakers"), "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "level")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as voice samples, 50 a recording: (recording_id, idx, start_ms, end_ms, duration_ms, truth, vector)."""
    e = table(spark, sf_dir, "embeddings")
    ms = 800 + F.pmod(F.col("vec_id") * 37, F.lit(4200))
    return e.select(F.floor(F.col("vec_id") / SAMPLES_PER_RECORDING).alias("recording_id"), F.col("vec_id").alias("idx"), (F.col("vec_id") * 5000).alias("start_ms"), (F.col("vec_id") * 5000 + ms).alias("end_ms"), ms.alias("duration_ms"), F.col("label").alias("truth"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def sample_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated turns about the samples: each one's label a little off its time, and in every fourth the next label for a third of it."""
    s, v, ms = samples(spark, sf_dir), F.col("idx"), F.col("duration_ms")
    start, half = F.col("start_ms") - 400 + v * 53 % 900, F.col("start_ms") + F.floor(ms / 2)
    own = s.select("recording_id", (v * 2).alias("idx"), start.alias("start_ms"), F.greatest(F.col("end_ms") - v * 29 % 1500, start + 100).alias("end_ms"), F.col("truth").cast("string").alias("speaker"))
    other = s.where(v % 4 == 1).select("recording_id", (v * 2 + 1).alias("idx"), half.alias("start_ms"), (half + F.floor(ms / 3)).alias("end_ms"), ((F.col("truth") + 1) % 4).cast("string").alias("speaker"))
    return own.union(other)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: (recording_id, idx, start_ms, end_ms, speaker), ten ms a character."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), (F.length("text") * 10).cast("long").alias("dur"))
    return rows.withColumn("start_ms", _starts("recording_id", "idx")).select("recording_id", "idx", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "speaker")


def hypothesis(spark: SparkSession, sf_dir: str, shift_ms: int = 500) -> DataFrame:
    """The turns again, late by ``shift_ms`` and, every fifth, under another name."""
    other = F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "user").otherwise("user")
    return turns(spark, sf_dir).select("recording_id", "idx", (F.col("start_ms") + shift_ms).alias("start_ms"), (F.col("end_ms") + shift_ms).alias("end_ms"), F.when(F.col("idx") % 5 == 4, other).otherwise(F.col("speaker")).alias("speaker"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of 100 ms with seven scores: (recording_id, frame, logits)."""
    e = table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    scores = F.array(*(((F.floor(F.col("event_id") / 3) * (31 + 7 * c) + 13 * c) % 17).cast("double") for c in range(C.CLASSES)))
    return e.select(F.col("user_id").alias("recording_id"), nth.cast("long").alias("frame"), scores.alias("logits"))


def totals(rows: DataFrame) -> DataFrame:
    """(recording_id, total_ms): where each recording ends."""
    return rows.groupBy("recording_id").agg(F.max("end_ms").alias("total_ms"))
