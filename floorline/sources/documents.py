"""JSON documents in and out: session exports, embedding dumps, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import rounded4

SPANS = "array<struct<startMs:double,endMs:double>>"
LOG = "array<struct<kind:string,atMs:bigint,detail:string>>"
#: Fields that older exports lack are null.
EXPORT = (
    "format string, version string, exportedAt string, speakerCount int, backgroundVoices boolean, elapsedMs double, coveredToMs double, backgroundMs double, "
    f"spans {SPANS}, durationsMs array<double>, creditedMs array<double>, levels array<double>, identities array<int>, vectors array<array<double>>, "
    "capture struct<userAgent:string,track:map<string,string>>, introductions struct<vectors:array<array<double>>,durationsMs:array<double>,profile:array<int>>, "
    f"log {LOG}"
)
DUMP = "name string, people int, totalMs double, spans array<struct<startMs:double,endMs:double,speaker:int>>, truthLabels array<string>, vectors array<array<double>>"
TRUTH = "meeting string, source string, durationMs bigint, shares map<string,int>, speakers array<string>, turns array<struct<startMs:bigint,endMs:bigint,speaker:string>>"
FORMAT_SUFFIX = "-diagnostics/1"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Session exports, one row a file, with ``recording_id`` from its name and ``known``, whether the version is."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return spark.read.schema(EXPORT).option("mode", "PERMISSIVE").json(path, multiLine=True).withColumn("recording_id", name).withColumn("known", F.col("format").endswith(FORMAT_SUFFIX))


def export_samples(exports: DataFrame) -> DataFrame:
    """The parallel arrays of an export as rows: (recording_id, idx, start_ms, end_ms, duration_ms, credited_ms, level, identity, vector)."""
    zipped = F.arrays_zip("spans", "durationsMs", "creditedMs", "levels", "identities", "vectors")
    return exports.select("recording_id", F.posexplode(zipped).alias("idx", "x")).select(
        "recording_id", F.col("idx").cast("long").alias("idx"), F.col("x.spans.startMs").alias("start_ms"), F.col("x.spans.endMs").alias("end_ms"), F.col("x.durationsMs").alias("duration_ms"),
        F.col("x.creditedMs").alias("credited_ms"), F.col("x.levels").alias("level"), F.col("x.identities").alias("identity"), F.col("x.vectors").alias("vector"),
    )


def export_log(exports: DataFrame) -> DataFrame:
    return exports.select("recording_id", F.explode("log").alias("e")).select("recording_id", "e.kind", F.col("e.atMs").alias("at_ms"), "e.detail")


def session_export(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row a session, in the layout of an export: arrays in order of idx, vectors to four places, no names, no sound.

    ``sessions`` has a row for each recording with its scalar fields.
    """
    row = F.struct("idx", "start_ms", "end_ms", "duration_ms", "credited_ms", "level", "identity", F.transform("vector", lambda x: rounded4(x)).alias("vector"))
    lists = samples.groupBy("recording_id").agg(F.sort_array(F.collect_list(row)).alias("_s"))
    of = lambda name: F.transform("_s", lambda s: s[name])
    arrays = lists.select("recording_id", F.transform("_s", lambda s: F.struct(s["start_ms"].alias("startMs"), s["end_ms"].alias("endMs"))).alias("spans"), of("duration_ms").alias("durationsMs"), of("credited_ms").alias("creditedMs"), of("level").alias("levels"), of("identity").alias("identities"), of("vector").alias("vectors"))
    return sessions.join(arrays, "recording_id").withColumn("format", F.lit("floorline" + FORMAT_SUFFIX))


def read_dumps(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return spark.read.schema(DUMP).option("pathGlobFilter", glob).json(path, multiLine=True)


def dump_samples(dumps: DataFrame) -> DataFrame:
    """(recording_id, people, total_ms, idx, start_ms, end_ms, duration_ms, truth, vector)."""
    each = dumps.select(F.col("name").alias("recording_id"), "people", F.col("totalMs").alias("total_ms"), F.posexplode(F.arrays_zip("spans", "truthLabels", "vectors")).alias("idx", "x"))
    return each.select("recording_id", "people", "total_ms", F.col("idx").cast("long").alias("idx"), F.col("x.spans.startMs").alias("start_ms"), F.col("x.spans.endMs").alias("end_ms"), (F.col("x.spans.endMs") - F.col("x.spans.startMs")).alias("duration_ms"), F.col("x.truthLabels").alias("truth"), F.col("x.vectors").alias("vector"))


def write_dumps(samples: DataFrame, path: str) -> None:
    """One JSON document a recording, in folders by recording."""
    row = F.struct("idx", F.struct(F.col("start_ms").cast("double").alias("startMs"), F.col("end_ms").cast("double").alias("endMs"), F.col("label").cast("int").alias("speaker")).alias("span"), F.col("truth").cast("string").alias("truth"), "vector")
    lists = samples.groupBy("recording_id", "people", "total_ms").agg(F.sort_array(F.collect_list(row)).alias("_s"))
    of = lambda name: F.transform("_s", lambda s: s[name])
    lists.select("recording_id", F.col("recording_id").alias("name"), "people", F.col("total_ms").cast("double").alias("totalMs"), of("span").alias("spans"), of("truth").alias("truthLabels"), of("vector").alias("vectors")).write.mode("overwrite").partitionBy("recording_id").json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotated turns: (recording_id, idx, start_ms, end_ms, speaker)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.truth)?(?:\.json)?$", 1)
    rows = spark.read.schema(TRUTH).json(path, multiLine=True).withColumn("recording_id", name)
    return rows.select("recording_id", F.posexplode("turns").alias("idx", "t")).select("recording_id", F.col("idx").cast("long").alias("idx"), F.col("t.startMs").cast("double").alias("start_ms"), F.col("t.endMs").cast("double").alias("end_ms"), F.col("t.speaker").alias("speaker"))


def truth_documents(turns: DataFrame) -> DataFrame:
    """One row a recording: distinct speakers in order, and turns by start."""
    row = F.struct(F.col("start_ms").cast("long").alias("startMs"), "idx", F.col("end_ms").cast("long").alias("endMs"), "speaker")
    lists = turns.groupBy("recording_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"), F.sort_array(F.collect_list(row)).alias("_t"))
    return lists.select("recording_id", "speakers", F.transform("_t", lambda t: F.struct(t["startMs"].alias("startMs"), t["endMs"].alias("endMs"), t["speaker"].alias("speaker"))).alias("turns"))


def read_annotated_corpus(spark: SparkSession, path: str, audio: str) -> DataFrame:
    """Turns of one recording of a Parquet corpus with parallel lists: (recording_id, idx, start_s, end_s, speaker)."""
    rows = spark.read.parquet(path).where(F.col("audio.path") == audio)
    return rows.select(F.col("audio.path").alias("recording_id"), F.posexplode(F.arrays_zip(F.col("timestamps_start").alias("a"), F.col("timestamps_end").alias("b"), F.col("speakers").alias("s"))).alias("idx", "x")).select("recording_id", F.col("idx").cast("long").alias("idx"), F.col("x.a").alias("start_s"), F.col("x.b").alias("end_s"), F.col("x.s").alias("speaker"))
