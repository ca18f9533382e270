"""Sound as rows: files, streams of one-second chunks, and conversations made up for tests."""

from __future__ import annotations

import io
import shutil
import subprocess
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.audio import to_16k_mono
from ..functions.constants import SAMPLE_RATE
from ..models import TONES

CHUNK_MS = 1_000
CHUNKS = "recording_id string, chunk long, start_ms long, samples array<float>"


def decode_wav(body: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1], frames x channels, and the rate of a PCM file."""
    with wave.open(io.BytesIO(body)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def decode_other(body: bytes) -> tuple[np.ndarray, int]:
    """The same of any other format, by the program ffmpeg where executors have it."""
    program = shutil.which("ffmpeg")
    if program is None:
        raise ValueError("only WAV files can be read here: ffmpeg isn't installed")
    done = subprocess.run([program, "-v", "error", "-i", "pipe:0", "-f", "f32le", "-ac", "1", "-ar", str(SAMPLE_RATE), "pipe:1"], input=body, capture_output=True)
    if done.returncode:
        raise ValueError(f"ffmpeg can't read the file: {done.stderr.decode(errors='replace').strip()}")
    return np.frombuffer(done.stdout, "<f4").astype(np.float64).reshape(-1, 1), SAMPLE_RATE


def decode(body: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a file in any format; WAV needs no other program."""
    return decode_wav(body) if body[:4] == b"RIFF" and body[8:12] == b"WAVE" else decode_other(body)


def encode_wav(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(SAMPLE_RATE)
        w.writeframes((np.clip(samples, -1, 1) * 32_767).astype("<i2").tobytes())
    return out.getvalue()


def chunked(recording_id: str, samples: np.ndarray) -> pd.DataFrame:
    starts = range(0, len(samples), SAMPLE_RATE * CHUNK_MS // 1000)
    return pd.DataFrame({"recording_id": recording_id, "chunk": range(len(starts)), "start_ms": [i * CHUNK_MS for i in range(len(starts))], "samples": [np.asarray(samples[s : s + SAMPLE_RATE], dtype=np.float32) for s in starts]})


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Chunks of one second of every file, named by its path; formats other than WAV need ffmpeg."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                yield chunked(name.rsplit("/", 1)[-1], to_16k_mono(*decode(body)))

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, CHUNKS)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.wav")


#: Turns of the recording that comes with the package, and how many people it has.
SAMPLE = (("A", 4.0), ("-", 1.0), ("B", 3.0), ("A", 6.5), ("C", 5.0), ("AB", 2.0), ("B", 4.0), ("C", 3.5), ("A", 5.0))
SAMPLE_COUNT = 3


def sample_recording(spark: SparkSession) -> DataFrame:
    """The chunks of a recording that needs no file, for a first try."""
    return recordings(spark, {"sample": conversation(SAMPLE)})


def live_source(spark: SparkSession, path: str, demo: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """A stream of chunks from ``path``; with ``demo`` the sample recording is played there first, so that no microphone is needed."""
    if demo:
        replay_file(sample_recording(spark), path)
    return stream_chunks(spark, path, files_per_trigger)


def stream_chunks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A microphone's chunks, as Parquet files that keep arriving in a folder."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay_file(chunks: DataFrame, path: str) -> str:
    """Writes a recording as such a folder, so that a file plays as a stream; ``stream_chunks`` reads it."""
    chunks.orderBy("recording_id", "chunk").coalesce(1).write.mode("append").parquet(path)
    return path


def _said(who: str, first: int, n: int, loud: float = 1) -> np.ndarray:
    """``n`` samples of test voices from the recording's sample ``first`` on."""
    t = (first + np.arange(n)) / SAMPLE_RATE
    which = np.floor(t / 0.1).astype(int) % 2
    return sum((0.3 * loud * np.sin(2 * np.pi * np.array(TONES[v])[which] * t) for v in who if v in TONES), np.zeros(len(t)))


def conversation(turns: Sequence[tuple]) -> np.ndarray:
    """Turns (who, seconds, amplitude = 1) of the test voices A, B, C, of AB together, and of silence, '-'.

    A voice goes from one of its tones to the other every tenth of a second, which is what tells voices apart.
    """
    pieces, offset = [], 0
    for who, seconds, *loud in turns:
        pieces.append(_said(who, offset, round(seconds * SAMPLE_RATE), *loud))
        offset += len(pieces[-1])
    return np.concatenate(pieces).astype(np.float32) if pieces else np.zeros(0, np.float32)


def test_signal(seed: int, n: int) -> np.ndarray:
    """Three tones and noise that depends on ``seed`` alone."""
    t = np.arange(n) / SAMPLE_RATE
    tones = 0.3 * np.sin(2 * np.pi * 220 * t) + 0.2 * np.sin(2 * np.pi * 880 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t)
    return (tones + 0.05 * (np.random.default_rng(seed).random(n) - 0.5)).astype(np.float32)


def make_voices(speakers: int, each: int, noise: float = 0.15, dim: int = 64, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors around ``speakers`` directions at right angles, in turn, with the number of each."""
    rng, block = np.random.default_rng(seed), dim // speakers
    labels = np.tile(np.arange(speakers), each)
    x = noise * (rng.random((len(labels), dim)) - 0.5) * 2
    for s in range(speakers):
        x[labels == s, s * block : (s + 1) * block] += 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True), labels


def recordings(spark: SparkSession, audio: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame(pd.concat([chunked(k, v) for k, v in audio.items()]).assign(samples=lambda x: x["samples"].map(np.ndarray.tolist)), CHUNKS)


def scripted(turns: DataFrame, voices: dict[str, str], pace: float = 1.0) -> DataFrame:
    """Turns (recording_id, idx, start_ms, end_ms, speaker) said by the test voices, as chunks (recording_id, chunk, start_ms, n, script)
    whose sound is made where it is heard: it is a hundred times as large as the turns, and isn't shuffled.

    ``voices`` names a voice for each speaker. A turn lasts its time times ``pace``, one after the other by idx; who has no voice, and a
    turn without an end, is silent. ``script`` lists what is said in the second: voice, first sample, number of samples.
    """
    size, who = SAMPLE_RATE * CHUNK_MS // 1000, F.lit("-")
    for name, voice in voices.items():
        who = F.when(F.col("speaker") == name, voice).otherwise(who)
    ms = F.coalesce(F.nanvl((F.col("end_ms") - F.col("start_ms")).cast("double"), F.lit(0.0)), F.lit(0.0))
    named = turns.select(F.col("recording_id").cast("string").alias("recording_id"), "idx", who.alias("who"), F.rint(F.greatest(ms * pace / 1000, F.lit(0.0)) * SAMPLE_RATE).cast("long").alias("n"))
    before = Window.partitionBy("recording_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0").withColumn("end", F.col("first") + F.col("n"))
    parts = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("end") - 1) / size))))
    first, end = F.greatest("first", F.col("chunk") * size), F.least("end", (F.col("chunk") + 1) * size)
    cut = parts.select("recording_id", "chunk", first.alias("first"), (end - first).cast("int").alias("n"), "who")
    each = cut.groupBy("recording_id", "chunk").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "n", "who"))).alias("script"))
    return each.select("recording_id", "chunk", (F.col("chunk") * CHUNK_MS).alias("start_ms"), "n", "script")


def heard(chunks: pd.DataFrame) -> Iterator[np.ndarray]:
    """The sound of each chunk: its samples, or what its script says."""
    if "samples" in chunks:
        yield from (np.asarray(s, dtype=np.float32) for s in chunks["samples"])
    else:
        for script in chunks["script"]:
            yield np.concatenate([_said(p["who"], p["first"], p["n"]) for p in script]).astype(np.float32)


def spoken(turns: DataFrame, voices: dict[str, str], pace: float = 1.0) -> DataFrame:
    """The chunks of ``scripted`` with their samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                some = pdf[i : i + 64]
                yield some[["recording_id", "chunk", "start_ms"]].assign(samples=list(heard(some)))

    return scripted(turns, voices, pace).mapInPandas(run, CHUNKS)


def totals(chunks: DataFrame) -> DataFrame:
    """(recording_id, total_ms)."""
    n = F.col("n") if "n" in chunks.columns else F.size("samples")
    return chunks.groupBy("recording_id").agg((F.sum(n) * 1000 / SAMPLE_RATE).alias("total_ms"))
