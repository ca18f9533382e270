"""Where live states go."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..sources.capture import place

EVENTS = "array<struct<kind:string,atMs:bigint,detail:string>>"


def write_states(updates: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch's states as Parquet in a folder of its number: a batch that is run again replaces its own."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return on_update(updates, put, checkpoint, trigger=trigger)


def on_update(updates: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Calls ``handler`` with the states of every micro-batch and its number."""
    return updates.writeStream.outputMode("update").foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(states: DataFrame) -> DataFrame:
    """The last state of each session."""
    return states.groupBy("session").agg(F.max_by(F.struct(*(c for c in states.columns if c != "session")), F.struct("seq", "covered_to_ms")).alias("s")).select("session", "s.*")


def event_log(states: DataFrame) -> DataFrame:
    """(session, kind, at_ms, detail) of all log entries that came with the states."""
    return states.where("events is not null").select("session", F.explode(F.from_json("events", EVENTS)).alias("e")).select("session", "e.kind", F.col("e.atMs").alias("at_ms"), "e.detail")


# --- epochs that appear whole or not at all ------------------------------------------------------

EPOCHS = "floorline_epochs"


@dataclass
class Part(WriterCommitMessage):
    """The file that a task has written; none if it had no rows."""

    file: str | None


class EpochWriter(DataSourceStreamArrowWriter):
    """Each task writes a Parquet file under a name of its own; a micro-batch counts once its list of files is in place.

    What a killed task leaves is in no list. A micro-batch that is committed again replaces its list, and the files of the old one go.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, path = place(self.folder)
        name, writer = None, None
        for batch in iterator:
            if writer is None:
                where.create_dir(f"{path}/parts", recursive=True)
                name = f"{uuid.uuid4().hex}.parquet"
                writer = pq.ParquetWriter(f"{path}/parts/{name}", batch.schema, filesystem=where)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
        return Part(name)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        _put_in_place(self.folder, batchId, [m.file for m in messages if m is not None and m.file])

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        where, path = place(self.folder)
        for m in messages:
            if m is not None and m.file:
                where.delete_file(f"{path}/parts/{m.file}")


def _put_in_place(folder: str, epoch: int, names: list[str]) -> None:
    """From here on the epoch consists of what ``names`` has of ``parts``, and of nothing else."""
    where, path = place(folder)
    where.create_dir(f"{path}/epochs", recursive=True)
    at = f"{path}/epochs/{epoch}.json"
    before = _listed(where, at)
    with where.open_output_stream(f"{at}.new") as f:
        f.write(json.dumps({"epoch": epoch, "files": sorted(names)}).encode())
    where.move(f"{at}.new", at)
    for name in before:
        old = f"{path}/parts/{name}"
        (where.delete_dir if where.get_file_info(old).type == fs.FileType.Directory else where.delete_file)(old)


def _listed(where: fs.FileSystem, at: str) -> list[str]:
    if where.get_file_info(at).type != fs.FileType.File:
        return []
    with where.open_input_stream(at) as f:
        return json.loads(f.read())["files"]


class Epochs(DataSource):
    """``writeStream.format("floorline_epochs")`` to a folder that the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return EPOCHS

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> EpochWriter:  # noqa: N802
        return EpochWriter(self.options["path"])


def write_epochs(rows: DataFrame, path: str, checkpoint: str, *, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch's rows, once each and whole or not at all, whatever fails; ``read_epochs`` reads them.

    Data sources in Python take mode ``append`` only. In other modes Spark's own writer makes a folder a micro-batch, which is put in
    place the same way.
    """
    if mode != "append":

        def put(batch: DataFrame, epoch: int) -> None:
            name = uuid.uuid4().hex
            batch.write.parquet(f"{path}/parts/{name}")
            _put_in_place(path, epoch, [name])

        return on_update(rows, put, checkpoint, trigger=trigger)
    rows.sparkSession.dataSource.register(Epochs)
    return rows.writeStream.format(EPOCHS).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def read_epochs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all micro-batches that are in place, with ``epoch``. The driver lists files, as it does for any folder."""
    lists = spark.read.schema("epoch bigint, files array<string>").json(f"{path}/epochs", pathGlobFilter="*.json")
    named = lists.select("epoch", F.explode("files").alias("_file"))
    files = [f"{path}/parts/{r._file}" for r in named.select("_file").collect()]
    if not files:
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(None).cast("long"))
    rows = spark.read.schema(schema).parquet(*files).withColumn("_file", F.regexp_extract(F.input_file_name(), "/parts/([^/]+)", 1))
    return rows.join(named, "_file").drop("_file")
