"""Token ids in length-delimited binary records: a data source that writes, commits and reads them, and shuffled reads by an index.

A folder of records holds pairs of files and ``manifest.json``, which names them in order with their records and ids. Only
what the manifest names exists: a task writes under names of its own, and the manifest is written when all tasks are done.

- A record file is a sequence of: length of the body (8 bytes), masked CRC-32 of these bytes (4), body, masked CRC-32 of the
  body (4). A body is one byte of flags (1: no document id, 2: ids take four bytes, else two), the document id (8), the ids.
- An index file has 24 bytes a record: where it begins, how long it is, and the ids of the records before it in the file.

All numbers are little-endian. A mask turns a checksum by 15 bits and adds a constant, so that a checksum of data that
holds checksums isn't degenerate.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import bounded_batches
from .tokens import Encoder

NAME = "floorline_records"
MANIFEST = "manifest.json"
#: Fixed values of the format.
MASK = 0xA282EAD8
HEAD, TAIL, BODY, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQQ")
NO_ID, WIDE = 1, 2
#: The id that ends a document.
END = 1
#: Bytes of ids that one batch of the reader holds at most, a longer record alone.
BATCH_BYTES = 8 << 20

ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("start", T.LongType())])


class BrokenRecord(ValueError):
    """A length or a checksum doesn't fit: the file is cut off or damaged."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    body = BODY.pack((doc_id is None) * NO_ID | wide * WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(body))
    return length + TAIL.pack(masked(length)) + body + TAIL.pack(masked(body))


def unframed(read: Any, where: str) -> tuple[int | None, np.ndarray] | None:
    """The next record of ``read(n)``, a function that gives n bytes or what is left; None at the end."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise BrokenRecord(f"{where}: cut off in a length")
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise BrokenRecord(f"{where}: checksum of a length")
    body, tail = read(length), read(TAIL.size)
    if len(body) < length or len(tail) < TAIL.size:
        raise BrokenRecord(f"{where}: cut off in a record")
    if masked(body) != TAIL.unpack(tail)[0]:
        raise BrokenRecord(f"{where}: checksum of a record")
    flags, doc_id = BODY.unpack_from(body)
    ids = np.frombuffer(body, dtype="<u4" if flags & WIDE else "<u2", offset=BODY.size)
    return None if flags & NO_ID else doc_id, ids.astype("<u4")


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], names=ROWS.names)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its place in the order, the stem of its files, records, ids and bytes."""

    at: int
    stem: str
    records: int
    ids: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    """Rows (doc_id, text), as they come, to one pair of files a task. What isn't committed is removed."""

    def __init__(self, folder: str, encoder: Encoder, end: int):
        self.folder, self.encoder, self.end = folder, encoder, end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        place, path = _place(self.folder)
        place.create_dir(path, recursive=True)
        at, stem = TaskContext.get().partitionId(), uuid.uuid4().hex
        records = ids = offset = 0
        with place.open_output_stream(f"{path}/{stem}.rec") as out, place.open_output_stream(f"{path}/{stem}.idx") as index:
            for batch in iterator:
                for doc_id, tokens in zip(batch.column(0).to_pylist(), self.encoder.encode(batch.column(1)), strict=True):
                    record = framed(doc_id, np.append(tokens, np.uint32(self.end)))
                    out.write(record)
                    index.write(ENTRY.pack(offset, len(record), ids))
                    records, ids, offset = records + 1, ids + len(tokens) + 1, offset + len(record)
        return Written(at, stem, records, ids, offset)

    def commit(self, messages: list[Written | None]) -> None:
        place, path = _place(self.folder)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.at):
            files.append({"stem": m.stem, "records": m.records, "ids": m.ids, "bytes": m.size, "start": start})
            start += m.ids
        place.create_dir(path, recursive=True)
        with place.open_output_stream(f"{path}/.{MANIFEST}") as out:
            out.write(json.dumps({"format": f"{NAME}/1", "end": self.end, "files": files}).encode())
        place.move(f"{path}/.{MANIFEST}", f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        place, path = _place(self.folder)
        for m in messages:
            if m is not None:
                for kind in ("rec", "idx"):
                    place.delete_file(f"{path}/{m.stem}.{kind}")


@dataclass
class RecordFile(InputPartition):
    stem: str
    start: int


class RecordReader(DataSourceReader):
    """One partition a file that the manifest names, in its order."""

    def __init__(self, folder: str, index: bool):
        self.folder, self.index = folder, index

    def partitions(self) -> list[RecordFile]:
        place, path = _place(self.folder)
        with place.open_input_stream(f"{path}/{MANIFEST}") as f:
            return [RecordFile(x["stem"], x["start"]) for x in json.loads(f.read())["files"]]

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        place, path = _place(self.folder)
        if self.index:
            yield from self._entries(place, path, partition)
            return
        rows, held, start = [], 0, partition.start
        with place.open_input_stream(f"{path}/{partition.stem}.rec", buffer_size=1 << 20) as f:
            while (record := unframed(f.read, partition.stem)) is not None:
                doc_id, ids = record
                if rows and held + ids.nbytes > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
                rows.append((doc_id, start, len(ids), ids.tobytes()))
                start, held = start + len(ids), held + ids.nbytes
        yield _batch(rows)

    def _entries(self, place: fs.FileSystem, path: str, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        with place.open_input_stream(f"{path}/{partition.stem}.idx", buffer_size=1 << 20) as f:
            while data := f.read(ENTRY.size << 15):
                at = np.frombuffer(data, dtype="<i8").reshape(-1, 3)
                name = pa.array([partition.stem] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(at[:, 2] + partition.start)], names=INDEX.names)


class Records(DataSource):
    """``format("floorline_records")``; the path is a folder that the driver and all executors share.

    Reading: ``rows`` is ``ids`` (doc_id, start, n_tokens, ids: unsigned little-endian 32-bit numbers) or ``index`` (file,
    offset, length, start). Writing: rows (doc_id, text) in the order that they have; ``tokenizer`` is a file of the tokenizers
    library, ``end`` the id that ends a document.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return INDEX if self.options.get("rows") == "index" else ROWS

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(self.options["path"], self.options.get("rows") == "index")

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], Encoder(self.options["tokenizer"]), int(self.options.get("end", END)))


def write_records(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Writes the token ids of ``docs`` to ``folder``, a new one, in ascending order of ``doc_id`` (an integer).

    Null ids come first; rows of one id in the order of a hash of their texts, equal rows one after the other. A null text is an
    empty one: its record holds only ``end``. An empty table makes a folder without records. Other columns don't matter,
    whatever their names. Rows are dealt into ranges of (id, hash, row number), so that no id fills a task.
    """
    bounded_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(Records)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    dealt = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").write.format(NAME).option("tokenizer", tokenizer).option("end", str(end)).mode("append").save(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records; ``start`` counts the ids of all records before. Checksums are checked."""
    spark.dataSource.register(Records)
    return spark.read.format(NAME).load(folder)


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """The same rows in an order that hangs on ``seed``: entries of the index are shuffled, and each task reads its records by them."""
    spark.dataSource.register(Records)
    entries = spark.read.format(NAME).option("rows", "index").load(folder)
    order = F.xxhash64(F.lit(seed), "start", "file")
    dealt = entries.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order", "start").drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = _place(folder)
        files: dict[str, Any] = {}
        try:
            for batch in batches:
                rows, held = [], 0
                for entry in batch.to_pylist():
                    if entry["file"] not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        files[entry["file"]] = place.open_input_file(f"{path}/{entry['file']}.rec")
                    files[entry["file"]].seek(entry["offset"])
                    doc_id, ids = unframed(files[entry["file"]].read, entry["file"])
                    if rows and held + ids.nbytes > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                    rows.append((doc_id, entry["start"], len(ids), ids.tobytes()))
                    held += ids.nbytes
                yield _batch(rows)
        finally:
            for f in files.values():
                f.close()

    return dealt.mapInArrow(run, ROWS)


def ids_crc32(ids: Column | str = "ids") -> Column:
    """The unsigned CRC-32 of the ids as little-endian 32-bit numbers."""
    return F.crc32(ids)
