"""Sinks of records: printed lines, nothing, files by hour, dead letters and topics."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kafka import Sasl, Tls, security


def utc(ts: str | Column, pattern: str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), pattern)


def line(df: DataFrame) -> DataFrame:
    """The printed form of a record: one text column."""
    parts = [F.coalesce(F.col("key"), F.lit("")), F.coalesce(F.col("value"), F.lit("")), utc("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("offset").cast("string")]
    return df.select(F.format_string("key=%s value=%s timestamp=%s offset=%s", *parts).alias("line"))


@dataclass
class Stdout:
    """Prints every record, partition by partition so that no more than one is on the driver at a time."""

    name: str = "Stdout"

    def write(self, df: DataFrame) -> int:
        n = 0
        for row in line(df).toLocalIterator():
            print(row.line)
            n += 1
        return n


@dataclass
class Blackhole:
    """Computes everything, keeps nothing, counts."""

    name: str = "Blackhole"
    count: int = 0

    def write(self, df: DataFrame) -> int:
        from pyspark.sql import Observation

        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        self.count += seen.get["n"]
        return self.count


def envelope(df: DataFrame) -> DataFrame:
    """Dead letters: when, and the record; a value that is JSON is embedded, another is a string."""
    quoted = F.to_json(F.struct(F.col("value").alias("v")))
    value = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.substring(quoted, 6, F.length(quoted) - 6))
    rest = F.to_json(F.struct(F.unix_micros("timestamp").__mul__(1000).alias("timestamp"), "offset", "partition", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")))
    head = F.to_json(F.struct(utc(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("dlq_time"), F.coalesce("key", F.lit("")).alias("key")))
    return df.select(F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"value":'), F.coalesce(value, F.lit("null")), F.lit(","), F.substring(rest, 2, F.length(rest))).alias("value"))


@dataclass
class FileDlq:
    """Dead letters as lines of JSON, added to a folder."""

    path: str
    name: str = "FileDLQ"

    def write(self, df: DataFrame) -> None:
        envelope(df).write.mode("append").text(self.path)


def hive_layout(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``date`` and ``hour`` (UTC) of each record: the folders that later scans prune by."""
    return df.withColumns({"date": utc(ts, "yyyy-MM-dd"), "hour": utc(ts, "HH")})


@dataclass
class ObjectStore:
    """JSON lines under ``prefix/date=/hour=``, on any path Spark writes to (``s3a://``, ``file:``)."""

    path: str
    compress: bool = False
    max_records: int = 5000
    name: str = "S3"
    partition_by: tuple[str, ...] = ("date", "hour")
    serializer: Column | None = None

    def write(self, df: DataFrame) -> None:
        body = self.serializer if self.serializer is not None else F.col("value")
        out = hive_layout(df).select(body.alias("value"), *self.partition_by)
        writer = out.write.mode("append").option("maxRecordsPerFile", self.max_records).partitionBy(*self.partition_by)
        (writer.option("compression", "gzip") if self.compress else writer).text(self.path)


ACKS = {"none": "0", "": "1", "leader": "1", "all": "all"}


@dataclass
class KafkaSink:
    """Spark's Kafka sink: at least once.

    Producers retry each record; what fails for good ends the job (``on_error="fail"``), or what is left of the (micro-)
    batch is logged and left out (``"drop"``): Spark has no finer grain."""

    brokers: tuple[str, ...]
    topic: str
    acks: str = "leader"
    batch_size: int = 100
    retries: int = 3
    sasl: Sasl | None = None
    tls: Tls | None = None
    serializer: Column | None = None
    name: str = "Kafka"
    extra: dict[str, str] = field(default_factory=dict)
    on_error: str = "fail"

    def options(self) -> dict[str, str]:
        if not self.brokers:
            raise ValueError("brokers is empty")
        if not self.topic:
            raise ValueError("topic is empty")
        out = {"kafka.bootstrap.servers": ",".join(self.brokers), "topic": self.topic, "kafka.acks": ACKS[self.acks], "kafka.retries": str(self.retries), "includeHeaders": "true"}
        return out | security(self.sasl, self.tls) | self.extra

    def rows(self, df: DataFrame) -> DataFrame:
        body = self.serializer if self.serializer is not None else F.col("value")
        headers = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e.key.alias("key"), e.value.cast("binary").alias("value")))
        return df.select("key", body.cast("string").alias("value"), headers.alias("headers"))

    def write(self, df: DataFrame) -> None:
        options, rows = self.options(), self.rows(df)
        try:
            rows.write.format("kafka").options(**options).save()
        except Exception as e:
            if self.on_error != "drop":
                raise
            logging.getLogger(__name__).warning("what was left of a batch for %s was dropped: %s", self.topic, type(e).__name__)


def kafka_dlq(brokers: tuple[str, ...], topic: str, **how: Any) -> KafkaSink:
    """Dead letters to a topic, acknowledged by all replicas."""
    return KafkaSink(brokers, topic, acks="all", name="KafkaDLQ", **how)


def json_payload(columns: list[str]) -> Column:
    """Columns as one JSON text."""
    return F.to_json(F.struct(*columns))
