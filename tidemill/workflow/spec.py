"""What a workflow file may say. Names of fields are the format's."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Duration:
    us: int = 0


@dataclass
class Checkpointing:
    interval: Duration = field(default_factory=Duration)
    dir: str = ""


@dataclass
class State:
    backend: str = ""
    dir: str = ""


@dataclass
class Env:
    bufferSize: int = 0  # noqa: N815
    shutdownTimeout: Duration = field(default_factory=Duration)  # noqa: N815
    checkpointing: Checkpointing | None = None
    state: State | None = None


@dataclass
class Record:
    key: str = ""
    value: str = ""


@dataclass
class Watermark:
    maxOutOfOrderness: Duration = field(default_factory=Duration)  # noqa: N815
    interval: Duration = field(default_factory=Duration)


@dataclass
class Sasl:
    mechanism: str = ""
    username: str = ""
    password: str = field(default="", repr=False)


@dataclass
class Tls:
    caFile: str = ""  # noqa: N815
    certFile: str = ""  # noqa: N815
    keyFile: str = ""  # noqa: N815
    insecureSkipVerify: bool = False  # noqa: N815


@dataclass
class KafkaSource:
    brokers: list[str] = field(default_factory=list)
    topic: str = ""
    topics: list[str] = field(default_factory=list)
    groupID: str = ""  # noqa: N815
    startFrom: str = ""  # noqa: N815
    exactlyOnce: bool = False  # noqa: N815
    parallel: bool = False
    watermark: Watermark | None = None
    deserialize: str = ""
    commitBatch: int = 0  # noqa: N815
    fetchMinBytes: int = 0  # noqa: N815
    fetchMaxBytes: int = 0  # noqa: N815
    sasl: Sasl | None = None
    tls: Tls | None = None


@dataclass
class Source:
    type: str = ""
    kafka: KafkaSource | None = None
    records: list[Record] = field(default_factory=list)


@dataclass
class Filter:
    field: str = ""
    operator: str = ""
    value: Any = None


@dataclass
class Select:
    fields: list[str] = field(default_factory=list)


@dataclass
class Renaming:
    # ``from`` is no name in Python: it is read as ``from_``.
    from_: str = ""
    to: str = ""


@dataclass
class Rename:
    renames: list[Renaming] = field(default_factory=list)


@dataclass
class Setting:
    field: str = ""
    value: Any = None


@dataclass
class SetFields:
    sets: list[Setting] = field(default_factory=list)


@dataclass
class KeyBy:
    field: str = ""
    partitions: int = 0
    label: str = ""


@dataclass
class Reduce:
    function: str = ""
    field: str = ""
    label: str = ""
    #: An addition to the format: ``final`` gives one row a group.
    emit: str = ""


@dataclass
class Window:
    type: str = ""
    size: Duration = field(default_factory=Duration)
    slide: Duration = field(default_factory=Duration)
    gap: Duration = field(default_factory=Duration)
    offset: Duration = field(default_factory=Duration)
    idleTimeout: Duration = field(default_factory=Duration)  # noqa: N815
    label: str = ""


@dataclass
class Ref:
    ref: str = ""
    label: str = ""
    parallelism: int = 0


@dataclass
class Operator:
    id: str = ""
    type: str = ""
    filter: Filter | None = None
    selectFields: Select | None = None  # noqa: N815
    renameFields: Rename | None = None  # noqa: N815
    setFields: SetFields | None = None  # noqa: N815
    keyBy: KeyBy | None = None  # noqa: N815
    reduce: Reduce | None = None
    window: Window | None = None
    map: Ref | None = None
    flatMap: Ref | None = None  # noqa: N815
    process: Ref | None = None


#: The operators: each is also the name of its block.
OPERATORS = ("filter", "selectFields", "renameFields", "setFields", "keyBy", "reduce", "window", "map", "flatMap", "process")


@dataclass
class KafkaSink:
    brokers: list[str] = field(default_factory=list)
    topic: str = ""
    batchSize: int = 0  # noqa: N815
    batchTimeout: Duration = field(default_factory=Duration)  # noqa: N815
    acks: str = ""
    # ``async`` is no name in Python: it is read as ``async_``.
    async_: bool = False
    serialize: str = ""
    maxRetries: int = 0  # noqa: N815
    onError: str = ""  # noqa: N815
    sasl: Sasl | None = None
    tls: Tls | None = None


@dataclass
class TxnKafkaSink:
    brokers: list[str] = field(default_factory=list)
    topic: str = ""
    transactionalID: str = ""  # noqa: N815
    markerTopic: str = ""  # noqa: N815
    serialize: str = ""
    sasl: Sasl | None = None
    tls: Tls | None = None


@dataclass
class PostgresSink:
    dsn: str = field(default="", repr=False)
    table: str = ""
    mapping: dict[str, str] = field(default_factory=dict)
    mode: str = ""
    conflictColumns: list[str] = field(default_factory=list)  # noqa: N815
    updateColumns: list[str] = field(default_factory=list)  # noqa: N815
    batchSize: int = 0  # noqa: N815
    flushInterval: Duration = field(default_factory=Duration)  # noqa: N815
    maxRetries: int = 0  # noqa: N815
    onError: str = ""  # noqa: N815


@dataclass
class Sink:
    type: str = ""
    kafka: KafkaSink | None = None
    txnKafka: TxnKafkaSink | None = None  # noqa: N815
    postgres: PostgresSink | None = None


@dataclass
class Workflow:
    name: str = ""
    version: str = ""
    env: Env | None = None
    source: Source = field(default_factory=Source)
    pipeline: list[Operator] = field(default_factory=list)
    sink: Sink = field(default_factory=Sink)
