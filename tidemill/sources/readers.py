"""Tables, inline records and generators as inputs, and the split of undecodable payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..envelope import EPOCH, from_records, from_slices

FAILURES = ("drop", "dlq", "fail")


def parquet(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """A Parquet table; as a stream, new files of its folder in turn."""
    if not streaming:
        return spark.read.parquet(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def inline(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records written into a workflow: key and value, numbered in order, at a fixed time."""
    return from_records(spark, [{"key": r.get("key"), "value": r["value"], "timestamp": EPOCH, "offset": i} for i, r in enumerate(records)])


def generator(spark: SparkSession, keys: list[str], values: list[str]) -> DataFrame:
    return from_slices(spark, keys, values)


def rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A load generator in the shape of records."""
    raw = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return raw.select(F.col("value").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp", F.col("value").alias("offset"), F.lit(0).alias("partition"), F.create_map().cast("map<string,string>").alias("headers"))


def deserialize(df: DataFrame, schema: str, value: str = "value", out: str = "parsed", on_error: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(decoded, failed): rows with ``out`` of a type by their JSON, and those whose JSON doesn't fit (with ``_error``).

    Both sides read the same plan. With ``fail``, the first row that doesn't fit ends the job.
    """
    if on_error not in FAILURES:
        raise ValueError(f"unsupported failure policy {on_error!r}")
    parsed = F.from_json(value, f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    df = df.withColumn("__p", parsed)
    bad = F.col("__p").isNull() | F.col("__p.__corrupt").isNotNull()
    names = [f.name for f in df.schema["__p"].dataType.fields if f.name != "__corrupt"]
    body = F.struct(*(F.col(f"__p.{n}").alias(n) for n in names))
    if on_error == "fail":
        body = F.when(bad, F.raise_error(F.concat(F.lit("undecodable value: "), F.col(value)))).otherwise(body)
        return df.withColumn(out, body).drop("__p"), df.limit(0).drop("__p").withColumn("_error", F.lit(""))
    return df.where(~bad).withColumn(out, body).drop("__p"), df.where(bad).drop("__p").withColumn("_error", F.lit("undecodable value"))
