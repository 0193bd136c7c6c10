"""Options for Spark's Kafka source. The connector itself is a package of Spark's that a cluster provides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = {"": "earliest", "earliest": "earliest", "latest": "latest"}
MECHANISMS = {"plain": "PLAIN", "scram-sha-256": "SCRAM-SHA-256", "scram-sha-512": "SCRAM-SHA-512"}


@dataclass(frozen=True)
class Sasl:
    mechanism: str
    username: str
    password: str = field(repr=False)

    def options(self) -> dict[str, str]:
        if self.mechanism.lower() not in MECHANISMS:
            raise ValueError(f"unsupported SASL mechanism {self.mechanism!r}")
        name = MECHANISMS[self.mechanism.lower()]
        module = "org.apache.kafka.common.security." + ("plain.PlainLoginModule" if name == "PLAIN" else "scram.ScramLoginModule")
        quoted = [x.replace("\\", "\\\\").replace('"', '\\"') for x in (self.username, self.password)]
        return {"kafka.sasl.mechanism": name, "kafka.sasl.jaas.config": f'{module} required username="{quoted[0]}" password="{quoted[1]}";'}


@dataclass(frozen=True)
class Tls:
    ca_file: str = ""
    cert_file: str = ""
    key_file: str = ""
    insecure_skip_verify: bool = False

    def options(self) -> dict[str, str]:
        out = {}
        if self.ca_file:
            out |= {"kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.location": self.ca_file}
        if self.cert_file or self.key_file:
            if not (self.cert_file and self.key_file):
                raise ValueError("a client certificate needs both a certificate and a key file")
            out |= {"kafka.ssl.keystore.type": "PEM", "kafka.ssl.keystore.location": self.cert_file, "kafka.ssl.key.location": self.key_file}
        if self.insecure_skip_verify:
            out["kafka.ssl.endpoint.identification.algorithm"] = ""
        return out


def security(sasl: Sasl | None, tls: Tls | None) -> dict[str, str]:
    if not sasl and not tls:
        return {}
    out = {"kafka.security.protocol": ("SASL_" if sasl else "") + ("SSL" if tls else "PLAINTEXT")}
    return out | (sasl.options() if sasl else {}) | (tls.options() if tls else {})


@dataclass(frozen=True)
class KafkaSource:
    brokers: tuple[str, ...]
    topics: tuple[str, ...]
    group_id: str = ""
    start: str = "earliest"
    exactly_once: bool = False
    parallel: bool = False
    min_bytes: int = 1
    max_bytes: int = 10 << 20
    max_retries: int = 5
    max_offsets: int | None = None
    sasl: Sasl | None = None
    tls: Tls | None = None

    def options(self) -> dict[str, str]:
        """Partitions are read in parallel and new ones found without being told; offsets live in the checkpoint."""
        if not self.brokers:
            raise ValueError("at least one broker is required")
        if not self.topics:
            raise ValueError("a topic (or topics) is required")
        if self.parallel and self.group_id:
            raise ValueError("parallel and group id are mutually exclusive")
        if self.parallel and len(self.topics) > 1:
            raise ValueError("parallel reads one topic")
        out = {"kafka.bootstrap.servers": ",".join(self.brokers), "subscribe": ",".join(self.topics), "startingOffsets": START[self.start], "includeHeaders": "true"}
        out |= {"kafka.fetch.min.bytes": str(self.min_bytes), "kafka.fetch.max.bytes": str(self.max_bytes)}
        out["fetchOffset.numRetries"] = str(self.max_retries if self.max_retries >= 0 else 2**31 - 1)
        if self.group_id:
            out["kafka.group.id"] = self.group_id
        if self.exactly_once:
            out["kafka.isolation.level"] = "read_committed"
        if self.max_offsets:
            out["maxOffsetsPerTrigger"] = str(self.max_offsets)
        return out | security(self.sasl, self.tls)

    def read(self, spark: SparkSession) -> DataFrame:
        return records(spark.readStream.format("kafka").options(**self.options()).load())


def records(raw: DataFrame) -> DataFrame:
    """Rows of the Kafka source as records."""
    headers = F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.struct(h.key, h.value.cast("string"))))
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "offset", "partition", headers.alias("headers"))
