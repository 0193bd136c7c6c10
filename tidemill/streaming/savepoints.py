"""Savepoints: a stopped query's checkpoint folder, copied under a label, from which another may start."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .ledger import _paths

LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def _copy(spark: SparkSession, source: str, target: str) -> None:
    fs, path = _paths(spark, source)
    to_fs, _ = _paths(spark, target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not fs.exists(path(source)):
        raise FileNotFoundError(source)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(source), to_fs, path(target), False, True, conf):
        raise OSError(f"{source} could not be copied to {target}")


def create(spark: SparkSession, checkpoint: str, root: str, label: str) -> str:
    """Copies the checkpoint of a query that doesn't run to ``root/label``."""
    if not LABEL.fullmatch(label):
        raise ValueError(f"invalid savepoint label {label!r}")
    fs, path = _paths(spark, root)
    target = f"{root}/{label}"
    if fs.exists(path(target)):
        raise FileExistsError(target)
    _copy(spark, checkpoint, target)
    return target


def restore(spark: SparkSession, root: str, label: str, checkpoint: str) -> None:
    """Puts a savepoint in place of a query's checkpoint."""
    fs, path = _paths(spark, checkpoint)
    fs.delete(path(checkpoint), True)
    _copy(spark, f"{root}/{label}", checkpoint)


def labels(spark: SparkSession, root: str) -> list[str]:
    fs, path = _paths(spark, root)
    return sorted(f.getPath().getName() for f in fs.listStatus(path(root))) if fs.exists(path(root)) else []
