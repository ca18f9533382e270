"""Sound and controls as they are captured: a data source that follows files which agents go on writing.

An agent, such as a page's server, appends the chunks and controls of all its sessions to one file, a JSON object a line. So
offsets are as many as agents, however many sessions there are.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

NAME = "floorline_capture"
SUFFIX = ".capture"
#: Bytes that one task reads, and that one step of the search for a line's end reads.
PIECE_BYTES, STEP_BYTES = 32 << 20, 64 << 10
BATCH_ROWS = 256
ARROW = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("samples", pa.list_(pa.float32())), ("verb", pa.string()), ("idx", pa.int32()), ("name", pa.string())])
SCHEMA = from_arrow_schema(ARROW)


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or an address, and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def line(session: str, seq: int, samples: np.ndarray | None = None, verb: str | None = None, idx: int | None = None, name: str | None = None) -> bytes:
    """What an agent appends for a chunk of sound (16-bit) or for a control, with the end of the line."""
    row: dict[str, Any] = {"session": session, "seq": seq, "verb": verb, "idx": idx, "name": name}
    if samples is not None:
        row["pcm"] = base64.b64encode(np.rint(np.clip(samples, -1, 1) * 32_767).astype("<i2").tobytes()).decode()
    return json.dumps({k: v for k, v in row.items() if v is not None}).encode() + b"\n"


def parsed(text: bytes) -> tuple:
    """A line as a row of ``SCHEMA``; what isn't one is a row without session, with verb 'broken' and the line as its name."""
    try:
        row = json.loads(text)
        pcm = row.get("pcm")
        samples = None if pcm is None else np.frombuffer(base64.b64decode(pcm, validate=True), "<i2").astype(np.float32) / 32_767
        out = (row["session"], row["seq"], samples, row.get("verb"), row.get("idx"), row.get("name"))
        pa.array([out[1]], pa.int64()), pa.array([out[4]], pa.int32()), pa.array([[out[0], out[3], out[5]]], pa.list_(pa.string()))
        return out
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError):
        return None, None, None, "broken", None, text.decode(errors="replace")


def complete_to(body: Any, start: int, limit: int) -> int:
    """Where the last whole line ends that ends within (start, limit]; if none does, the first one's end after that, or ``start``."""
    at = limit
    while at > start:
        low = max(start, at - STEP_BYTES)
        body.seek(low)
        found = body.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    body.seek(limit)
    at = limit
    while block := body.read(STEP_BYTES):  # one line is longer than what is let in
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return start


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin within [start, end)."""

    file: str
    start: int
    end: int
    first: bool


class CaptureReader(DataSourceStreamReader):
    """Offsets are {file: bytes}, always at the end of a line.

    Only ``limit`` bytes of a file are let into a batch (one line at least). Spark doesn't tell a restarted reader where it stands before it
    asks how far to go, so that ``partitions`` notes in ``cursor`` what it was last asked for: the note is behind Spark's own log only if
    Spark will first ask for that batch again. Where the reader doesn't know, all there is is let in.
    """

    def __init__(self, folder: str, limit: int | None, cursor: str | None):
        self.folder, self.limit, self.cursor = folder, limit, cursor
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {}
        return {}

    def _noted(self) -> dict | None:
        if self.at is None and self.cursor:
            where, path = place(self.cursor)
            if where.get_file_info(path).type == fs.FileType.File:
                with where.open_input_stream(path) as f:
                    self.at = json.loads(f.read())
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        where, path = place(self.folder)
        at, out = self._noted(), {}
        for info in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(SUFFIX):
                start = (at or {}).get(info.base_name, 0)
                to = info.size if at is None or self.limit is None else min(info.size, start + self.limit)
                if to > start:
                    with where.open_input_file(info.path) as body:
                        start = complete_to(body, start, to)
                if start:
                    out[info.base_name] = start
        return {**(at or {}), **out}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if end != self.at and self.cursor:
            where, path = place(self.cursor)
            with where.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            where.move(f"{path}.new", path)
        self.at = dict(end)
        return [Piece(f, a, min(a + PIECE_BYTES, to), a == start.get(f, 0)) for f, to in sorted(end.items()) for a in range(start.get(f, 0), to, PIECE_BYTES)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        where, path = place(self.folder)
        rows: list[tuple] = []
        with where.open_input_file(f"{path}/{partition.file}") as body:
            for text in _lines(body, partition):
                rows.append(parsed(text))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _lines(body: Any, piece: Piece) -> Iterator[bytes]:
    """The lines that begin in a piece. All but a batch's first piece of a file look for the end of the line that they begin in."""
    at = piece.start if piece.first else piece.start - 1
    body.seek(at)
    held, skip = b"", not piece.first
    while block := body.read(STEP_BYTES):
        held += block
        *whole, rest = held.split(b"\n")
        for text in whole:
            here, at = at, at + len(text) + 1
            if skip:
                skip = False
            elif here >= piece.end:
                return
            else:
                yield text
        held = rest
        if not skip and at >= piece.end:
            return


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Capture(DataSource):
    """``readStream.format("floorline_capture")``: rows (session, seq, samples, verb, idx, name) of the ``*.capture`` files in a shared folder.

    ``maxBytesPerFile`` is what of a file is let into a batch, ``cursor`` a file beside the checkpoint, of this query alone.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> CaptureReader:  # noqa: N802
        limit = self.options.get("maxBytesPerFile")
        return CaptureReader(self.options["path"], None if limit is None else max(1, int(limit)), self.options.get("cursor"))


def captured(spark: SparkSession, folder: str, cursor: str | None = None, max_bytes_per_file: int | None = None) -> DataFrame:
    """The stream of what agents append in ``folder``, for ``live_updates``; a line that is still being written waits until it is whole.

    With the trigger ``availableNow`` a batch is made once, so ``max_bytes_per_file`` is for jobs that go on.
    """
    spark.dataSource.register(Capture)
    reader = spark.readStream.format(NAME)
    for key, value in (("cursor", cursor), ("maxBytesPerFile", max_bytes_per_file)):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(folder)
