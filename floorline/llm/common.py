"""What the operators of this subpackage share: tables, checkpoints, and running totals that no hot key can skew."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bytes that Spark puts into one Arrow batch at most, so that long texts don't fill a Python worker.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a folder of this machine serves, but only if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="floorline-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes ``folder``, wherever Spark can write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the executors share, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_rows(docs: DataFrame, text: str, batches: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``batches``, a filter that is told where the column ``text`` is; columns may have any names."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(lambda some: batches(some, at), plain.schema).toDF(*docs.columns)


def unit_interval(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone: 52 bits of their MD5."""
    text = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def running_total(df: DataFrame, keys: list[str], bin_: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds to each row the sum of ``value`` over the rows before it in its key.

    ``bin_`` names a column that rises with ``order``. Sums for each bin are made first, so that a task holds the
    rows of one bin of one key, and of the keys only their sums for each bin. Keys and bins aren't null.
    """
    before = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bin_).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*keys, bin_, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return (
        df.withColumn("_value", value)
        .withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(starts, [*keys, bin_])
        .withColumn(out, F.col("_start") + F.col("_within"))
        .drop("_value", "_within", "_start")
    )
