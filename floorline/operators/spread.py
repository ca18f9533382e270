"""Groups for Python work, dealt over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData


def by(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` by ``keys``, in a number of tasks that adaptive plans leave alone.

    These go by bytes, and put groups of small rows into one task however long the work on each takes.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys).groupBy(*keys)
