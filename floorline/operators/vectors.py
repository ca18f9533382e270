"""Centroids, centring, nearest neighbours and pair distances over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import constants as C
from ..functions.vectors import cosine_distance, dot, normalise


#: Groups whose sums a task holds before it passes them on.
HELD_GROUPS = 10_000


def vector_sums(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, total, n): the sum of the column ``vector`` over each group, times ``weight`` if one is named, and the number of vectors.

    Two phases: a task adds up whole vectors by group, so that what is shuffled is a row a group and task, whatever the width;
    then these rows are added up. Null vectors don't count. Vectors of a group have one width; a null weight is 0.
    """
    kinds = [rows.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    weights = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    narrow = rows.where("vector is not null").select(*keys, F.col("vector").cast("array<double>").alias("_v"), weights.alias("_w"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            at = np.array([number[name] for name in names], dtype=np.int64)
            vectors, w = batch.column(len(keys)), batch.column(len(keys) + 1).to_numpy()
            flat, edges = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            widths = np.diff(edges)
            for name, i in number.items():
                on = np.flatnonzero(at == i) if len(number) <= 64 else None
                held.setdefault(name, [None, 0])
                if on is not None:
                    part = (flat.reshape(-1, widths[0])[on] * w[on, None]).sum(axis=0) if len(set(widths.tolist())) == 1 and widths[0] else None
                    if part is not None:
                        held[name] = [part if held[name][0] is None else held[name][0] + part, held[name][1] + len(on)]
                        continue
                for j in np.flatnonzero(at == i) if on is None else on:
                    part = flat[edges[j] - edges[0] : edges[j + 1] - edges[0]] * w[j]
                    held[name] = [part if held[name][0] is None else held[name][0] + part, held[name][1] + 1]
            if len(held) > HELD_GROUPS:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[tuple, list]) -> pa.RecordBatch:
        fields = to_arrow_schema(schema)
        columns = [[name[i] for name in held] for i in range(len(keys))] + [[total.tolist() for total, _ in held.values()], [n for _, n in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    parts = narrow.mapInArrow(add, schema)
    # a row a group and task: few enough to be put side by side, number by number
    added = parts.groupBy(*keys).agg(F.collect_list("total").alias("_parts"), F.sum("n").alias("n"))
    total = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.get("_parts", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda a, b: a + b))
    return added.select(*keys, total.alias("total"), "n")


def centroids(samples: DataFrame, keys: list[str], weight: str | None = "duration_ms") -> DataFrame:
    """(keys, centroid): unit vector of the sum of the vectors, times ``weight`` if one is named."""
    return vector_sums(samples, keys, weight).select(*keys, normalise(F.col("total")).alias("centroid"))


def centre(samples: DataFrame, least: int = C.MIN_FOR_CENTRING) -> DataFrame:
    """``samples`` with vectors less their recording's mean, at unit length; recordings of fewer than ``least`` as they are."""
    sums = vector_sums(samples, ["recording_id"]).select("recording_id", F.transform("total", lambda x: x / F.col("n")).alias("_mean"), F.col("n").alias("_n"))
    joined = samples.join(sums, "recording_id").withColumn("_moved", F.zip_with("vector", "_mean", lambda a, b: a.cast("double") - b))
    # a column of its own, for within a lambda the length would be worked out for each number
    measured = joined.withColumn("_length", F.sqrt(dot(F.col("_moved"), F.col("_moved"))))
    unit_length = F.when(F.col("_length") == 0, F.col("_moved")).otherwise(F.transform("_moved", lambda x: x / F.col("_length")))
    return measured.withColumn("vector", F.when(F.col("_n") < least, F.transform("vector", lambda x: x.cast("double"))).otherwise(unit_length)).drop("_mean", "_n", "_moved", "_length")


def nearest(samples: DataFrame, centres: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``nearest``, ``distance``, ``margin``: the closest of the recording's centroids, ties to the lowest label.

    A recording has as many centroids as people, so they travel as one array a recording. Without one all three are
    null; the margin to the second is infinite with only one.
    """
    lists = centres.where("centroid is not null").groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_centres"))
    ranked = F.sort_array(F.transform("_centres", lambda x: F.struct(cosine_distance(F.col("vector"), x["c"]).alias("d"), x["l"].alias("l"))))
    met = samples.join(lists, "recording_id", "left").withColumn("_ranked", ranked)
    margin = F.when(F.size("_ranked") > 1, F.col("_ranked")[1]["d"] - F.col("_ranked")[0]["d"]).when(F.size("_ranked") == 1, float("inf"))
    return met.select(*samples.columns, F.col("_ranked")[0]["l"].alias("nearest"), F.col("_ranked")[0]["d"].alias("distance"), margin.alias("margin"))


def pair_distances(samples: DataFrame) -> DataFrame:
    """(recording_id, a, b, distance) for all a < b of a recording, by one matrix product a recording.

    A recording holds hundreds of samples, not more; the pairs are the result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        i, j = np.triu_indices(len(x), 1)
        ids = pdf["idx"].to_numpy()
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "a": ids[i], "b": ids[j], "distance": 1.0 - (x @ x.T)[i, j]})

    kind = samples.schema["recording_id"].dataType.simpleString()
    return samples.select("recording_id", "idx", "vector").groupBy("recording_id").applyInPandas(run, f"recording_id {kind}, a long, b long, distance double")


def blocks_of_distances(samples: DataFrame, centres: np.ndarray) -> DataFrame:
    """(recording_id, idx, distances): to a few given unit vectors, a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"recording_id": pdf["recording_id"], "idx": pdf["idx"], "distances": list(1.0 - x @ centres.T)})

    kind = samples.schema["recording_id"].dataType.simpleString()
    return samples.select("recording_id", "idx", "vector").mapInPandas(run, f"recording_id {kind}, idx long, distances array<double>")
