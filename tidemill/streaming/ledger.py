"""Output exactly once: each micro-batch is written under its number, and a ledger says which are committed.

A batch is prepared in a folder of its own, then entered in the ledger by one rename, which either happens or doesn't.
A batch that runs again after a failure finds itself in the ledger and does nothing, or writes its folder anew.
Readers take the folders that the ledger lists. The folder may be on any file system with atomic renames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _paths(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


@dataclass
class LedgerSink:
    path: str
    query: str
    hook: Callable[[str, int], None] | None = None  # called at each step, for tests of recovery
    name: str = "Ledger"

    def _at(self, what: str, batch: int) -> str:
        return f"{self.path}/{what}/{self.query}/batch={batch}"

    def was_committed(self, spark: SparkSession, batch: int) -> bool:
        fs, path = _paths(spark, self.path)
        return fs.exists(path(self._at("ledger", batch)))

    def write_batch(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if self.was_committed(spark, batch):
            return
        self._step("begin", batch)
        df.write.mode("overwrite").parquet(self._at("data", batch))
        self._step("prepared", batch)
        fs, path = _paths(spark, self.path)
        # An entry is made beside its place and moved there: a crash leaves either none or a whole one.
        pending = path(self._at("pending", batch))
        fs.create(pending, True).close()
        fs.mkdirs(path(f"{self.path}/ledger/{self.query}"))
        self._step("marked", batch)
        if not fs.rename(pending, path(self._at("ledger", batch))) and not self.was_committed(spark, batch):
            raise RuntimeError(f"batch {batch} could not be committed")
        self._step("committed", batch)

    def _step(self, step: str, batch: int) -> None:
        if self.hook:
            self.hook(step, batch)

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """The rows of committed batches."""
        fs, path = _paths(spark, self.path)
        root = path(f"{self.path}/ledger/{self.query}")
        done = sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []
        if not done:
            return spark.createDataFrame([], schema or "batch int")
        return spark.read.parquet(*(f"{self.path}/data/{self.query}/{b}" for b in done))
