"""The record envelope: what Kafka and workflow files work on. Typed tables keep their own columns instead."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, timestamp timestamp, offset bigint, partition int, headers map<string,string>"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def record(value: str, key: str | None = None, timestamp: datetime | None = None, offset: int = 0, partition: int = 0, headers: dict[str, str] | None = None) -> dict[str, Any]:
    """One record, stamped with the present time unless told otherwise."""
    return {"key": key, "value": value, "timestamp": timestamp or datetime.now(UTC), "offset": offset, "partition": partition, "headers": headers or {}}


def from_records(spark: SparkSession, records: Iterable[dict[str, Any]]) -> DataFrame:
    """Records in order; those without an offset get their place in the list."""
    names = ["key", "value", "timestamp", "offset", "partition", "headers"]
    rows = [tuple((i if n == "offset" and n not in r else {} if n == "headers" and n not in r else 0 if n == "partition" and n not in r else r.get(n)) for n in names) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def from_slices(spark: SparkSession, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    if len(keys) != len(values):
        raise ValueError(f"{len(keys)} keys and {len(values)} values")
    now = datetime.now(UTC)
    return from_records(spark, [record(v, k, now, i) for i, (k, v) in enumerate(zip(keys, values, strict=True))])


def to_envelope(df: DataFrame, key: str, timestamp: str, offset: str, value: str | None = None) -> DataFrame:
    """A typed table as records; the value is the row as JSON unless a column has it."""
    payload = F.col(value) if value else F.to_json(F.struct(*df.columns))
    return df.select(
        F.col(key).cast("string").alias("key"), payload.alias("value"), F.col(timestamp).cast("timestamp").alias("timestamp"), F.col(offset).cast("bigint").alias("offset"),
        F.lit(0).alias("partition"), F.create_map().cast("map<string,string>").alias("headers"),
    )


def with_headers(df: DataFrame, **headers: Any) -> DataFrame:
    """Headers added to those a record has; later ones win."""
    new = F.create_map(*(x for k, v in headers.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))))
    old = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(headers)))
    return df.withColumn("headers", F.map_concat(old, new))


def window_headers(df: DataFrame, window: str = "window") -> DataFrame:
    """Window bounds as ``window_start`` and ``window_end`` headers in RFC 3339, UTC; the partition is no more."""

    def stamp(c: str) -> Any:
        at = F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(at, "0+$", ""), r"\.$", ""), F.lit("Z"))

    return with_headers(df, window_start=stamp(f"{window}.start"), window_end=stamp(f"{window}.end")).drop(window).withColumn("partition", F.lit(None).cast("int"))
