"""Sessions configured for this engine: UTC, adaptive plans, RocksDB for streaming state."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "floorline", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def capabilities() -> dict[str, bool]:
    """What this environment offers: the packages that the Python stages need."""
    from importlib.util import find_spec

    found = {p: find_spec(p) is not None for p in ("numpy", "pandas", "pyarrow", "onnxruntime")}
    return found | {"supported": found["numpy"] and found["pandas"] and found["pyarrow"]}
