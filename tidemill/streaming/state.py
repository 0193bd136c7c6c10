"""State stores by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDERS = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "disk": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def use_backend(spark: SparkSession, backend: str) -> None:
    if backend not in PROVIDERS:
        raise ValueError(f"unsupported state backend {backend!r} (memory or disk)")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDERS[backend])
    if backend == "disk":
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
