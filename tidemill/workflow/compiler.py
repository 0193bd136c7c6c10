"""Workflows as pipelines over records.

Every operator becomes columns on the JSON of a record. Records that can't be decoded are dropped by a filter, pass
through field operators as they are, have the empty key, add nothing to a sum and count as one.
A transactional topic is written at least once here (Spark's Kafka sink has no transactions); the ledger sink gives
exactly once for files. ``Compiled.delivered`` says which guarantee the compiled pipeline really has.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..envelope import window_headers
from ..functions import json_paths as J
from ..functions.durations import text
from ..functions.reducers import Reducer, count
from ..functions.windows import Assigner, Session, Sliding, Tumbling
from ..operators.stream import Stream, StreamEnv
from ..sinks.basic import Blackhole, KafkaSink, Stdout
from ..sinks.postgres import PostgresSink
from ..sources import kafka as K
from ..sources.readers import deserialize, inline
from .spec import Operator, Sasl, Tls, Workflow
from .validate import guarantee, place, validate

DATA_ROOT = "tidemill-data"
SECRET = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


class CompileError(ValueError):
    pass


# -- secrets --------------------------------------------------------------------------------------------------------


def from_environment(name: str) -> str:
    if name not in os.environ:
        raise KeyError(name)
    return os.environ[name]


def revealed(field: str, value: str, resolve: Callable[[str], str]) -> str:
    """``value`` with its ``${NAME}`` references filled in; faults never show a value."""

    def one(m: re.Match) -> str:
        try:
            return resolve(m[1])
        except Exception:
            raise CompileError(f'{field}: secret "{m[1]}" could not be resolved') from None

    out, left = SECRET.sub(one, value), SECRET.sub("", value)
    if "${" in left:
        raise CompileError(f"{field}: invalid secret reference syntax")
    return out


def with_secrets(wf: Workflow, resolve: Callable[[str], str]) -> Workflow:
    """A copy whose credentials and Postgres DSN are filled in. Nothing else is looked at."""

    def opened(owner: Any) -> Any:
        if owner is None or getattr(owner, "sasl", None) is None:
            return owner
        s: Sasl = owner.sasl
        sasl = dataclasses.replace(s, username=revealed("username", s.username, resolve), password=revealed("password", s.password, resolve))
        return dataclasses.replace(owner, sasl=sasl)

    sink = wf.sink
    if sink.type == "postgres" and sink.postgres:
        sink = dataclasses.replace(sink, postgres=dataclasses.replace(sink.postgres, dsn=revealed("dsn", sink.postgres.dsn, resolve)))
    elif sink.type in ("kafka", "txnKafka"):
        sink = dataclasses.replace(sink, **{sink.type: opened(getattr(sink, sink.type))})
    return dataclasses.replace(wf, source=dataclasses.replace(wf.source, kafka=opened(wf.source.kafka)), sink=sink)


# -- operators ------------------------------------------------------------------------------------------------------


def spoken_number(x: Column) -> Column:
    """A sum as JSON: whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def assigner(op: Operator) -> Assigner:
    w = op.window
    size, slide, gap, offset = (f"{d.us * 1000}ns" for d in (w.size, w.slide, w.gap, w.offset))
    return {"tumbling": lambda: Tumbling(size, offset), "sliding": lambda: Sliding(size, slide, offset), "session": lambda: Session(gap)}[w.type]()


def apply(stream: Stream, pipeline: list[Operator], registry: dict[str, Callable[[Stream], Stream]] | None = None) -> Stream:
    """The operators on a stream of records, in order."""
    for i, op in enumerate(pipeline):
        stream = one(stream, i, op, registry or {})
    return stream


def one(stream: Stream, i: int, op: Operator, registry: dict[str, Callable[[Stream], Stream]]) -> Stream:
    if op.type == "filter":
        f = op.filter
        return stream.filter(J.compare(J.decoded(F.col("value")), f.field, f.operator, f.value), op.id)
    if op.type == "selectFields":
        return stream.apply(J.staged(stream.df, [], out=lambda v: J.select(v, op.selectFields.fields)), "Map", op.id)
    if op.type == "renameFields":
        steps = [lambda v, x=x: J.rename(v, x.from_, x.to) for x in op.renameFields.renames]
        return stream.apply(J.staged(stream.df, steps), "Map", op.id)
    if op.type == "setFields":
        steps = [lambda v, x=x: J.put(v, x.field, J.constant(x.value)) for x in op.setFields.sets]
        return stream.apply(J.staged(stream.df, steps), "Map", op.id)
    if op.type == "keyBy":
        path = op.keyBy.field

        def spoken(x: Column, kind: Column) -> Column:
            literal = J.text_at(F.col("value"), path)  # 1.0 stays 1.0
            return F.when(kind == "null", "<nil>").when(kind.isin("object", "array"), F.to_json(x)).when(x.isNotNull(), literal)

        key = J.bound(J.get(J.decoded(F.col("value")), path), lambda x: J.bound(J.kind(x), lambda kind: spoken(x, kind)))
        return stream.key_by(key, op.keyBy.partitions or None, op.keyBy.label or op.id)
    if op.type == "window":
        if op.window.idleTimeout.us and stream.df.isStreaming:
            raise CompileError(f"{place(i, op)}.window.idleTimeout: Spark closes windows by its watermark alone; leave it out (a batch ends all windows anyway)")
        return stream.window(assigner(op), op.window.label or op.id)
    if op.type == "reduce":
        return reduced(stream, op)
    ref = getattr(op, op.type).ref
    if ref not in registry:
        raise CompileError(f'{place(i, op)}: {op.type} refers to "{ref}", and no such function is registered')
    return registry[ref](stream)


def reduced(stream: Stream, op: Operator) -> Stream:
    """The payload after a reduce is its accumulator alone; the key stays beside it."""
    r, mode = op.reduce, op.reduce.emit or "running"
    if r.function == "count":
        by, payload = count("__acc"), lambda: F.concat(F.lit('{"count":'), F.col("__acc").cast("string"), F.lit("}"))
    else:
        by, payload = _sum(r.field), lambda: F.concat(F.lit('{"sum":'), spoken_number(F.col("__acc")), F.lit("}"))
    if mode == "running" and stream.df.isStreaming and r.function == "sum":
        stream = stream.map(__term=J.number(J.decoded(F.col("value")), r.field))
    out = stream.reduce(by, mode=mode, label=r.label or op.id)
    if mode == "final":
        df = out.df.withColumns({"value": payload(), "timestamp": F.lit(None).cast("timestamp"), "offset": F.lit(None).cast("bigint"), "headers": F.create_map().cast("map<string,string>")})
    else:
        df = out.df.withColumn("value", payload()).drop("__term")
    return dataclasses.replace(out, df=df.drop("__acc").withColumn("partition", F.lit(None).cast("int")))


def _sum(field: str) -> Reducer:
    term = J.number(J.decoded(F.col("value")), field)
    return Reducer("__acc", lambda _: F.sum(term), lambda acc, row: (acc or 0.0) + row["__term"])


# -- the whole -------------------------------------------------------------------------------------------------------


def _security(sasl: Sasl | None, tls: Tls | None) -> dict[str, Any]:
    return {"sasl": K.Sasl(sasl.mechanism, sasl.username, sasl.password) if sasl else None, "tls": K.Tls(tls.caFile, tls.certFile, tls.keyFile, tls.insecureSkipVerify) if tls else None}


def kafka_source(wf: Workflow) -> K.KafkaSource:
    k = wf.source.kafka
    if k.parallel:
        raise CompileError("source.kafka: parallel is not supported in workflow files")
    if not k.groupID:
        raise CompileError("source.kafka.groupID: a group id is required")
    if k.startFrom not in K.START:
        raise CompileError(f'source.kafka.startFrom: unsupported start "{k.startFrom}" (earliest or latest)')
    sizes = {n: v for n, v in (("min_bytes", k.fetchMinBytes), ("max_bytes", k.fetchMaxBytes)) if v}
    limit = wf.env.bufferSize if wf.env and wf.env.bufferSize else None
    return K.KafkaSource(tuple(k.brokers), tuple(k.topics or [k.topic]), k.groupID, k.startFrom or "earliest", k.exactlyOnce, max_offsets=limit, **sizes, **_security(k.sasl, k.tls))


def sink(wf: Workflow, connect: Callable[[str], Any] | None = None) -> Any:
    s = wf.sink
    if s.type == "stdout":
        return Stdout()
    if s.type == "blackhole":
        return Blackhole()
    c = getattr(s, s.type)
    if getattr(c, "onError", "") not in ("", "drop", "fail"):
        raise CompileError(f'sink.{s.type}.onError: "{c.onError}" is not supported in workflow files')
    if s.type in ("kafka", "txnKafka"):
        if c.serialize not in ("", "json"):
            raise CompileError(f'sink.{s.type}.serialize: unsupported serializer "{c.serialize}"')
        more = {"acks": c.acks, "batch_size": c.batchSize or 100, "retries": c.maxRetries or 3, "on_error": c.onError or "drop"} if s.type == "kafka" else {"acks": "all", "name": "TxnKafka"}
        return KafkaSink(tuple(c.brokers), c.topic, **more, **_security(c.sasl, c.tls))
    dsn = c.dsn
    return PostgresSink((lambda: connect(dsn)) if connect else _no_driver, c.table, dict(c.mapping), c.mode or "insert", tuple(c.conflictColumns), tuple(c.updateColumns), c.batchSize or 100, c.maxRetries or 3, on_error=c.onError or "drop")


def _no_driver() -> Any:
    raise RuntimeError("no Postgres driver was given to the compiler")


def safe_name(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_.-]", "_", name.strip())
    return "default" if out in ("", ".", "..") else out


def folder(configured: str, root: str, name: str, what: str) -> str:
    return os.path.join(configured, safe_name(name)) if configured else os.path.join(root, safe_name(name), what)


@dataclass
class Compiled:
    env: StreamEnv
    stream: Stream
    guarantee: str
    delivered: str
    graph: dict[str, Any]

    def graph_json(self) -> str:
        return json.dumps(self.graph, indent=2)


def graph(wf: Workflow) -> dict[str, Any]:
    return {
        "name": wf.name, "source": wf.source.type, "sink": wf.sink.type, "delivery": guarantee(wf),
        "operators": [{"id": op.id, "type": op.type} for op in wf.pipeline],
    }


def compile(wf: Workflow, spark: SparkSession, resolve: Callable[[str], str] = from_environment, registry: dict[str, Callable[[Stream], Stream]] | None = None, source: DataFrame | None = None, data_root: str = DATA_ROOT, connect: Callable[[str], Any] | None = None) -> Compiled:  # noqa: A001
    """Validate, fill in secrets, then source, environment, operators and sink. ``source`` stands in for the topic."""
    validate(wf)
    wf = with_secrets(wf, resolve)
    env = StreamEnv(spark)
    if e := wf.env:
        if e.bufferSize:
            env.with_buffer_size(e.bufferSize)
        if e.shutdownTimeout.us:
            env.with_shutdown_timeout(f"{e.shutdownTimeout.us}us")
        if e.checkpointing:
            env.with_checkpointing(f"{e.checkpointing.interval.us}us", folder(e.checkpointing.dir, data_root, wf.name, "checkpoints"))
        if e.state:
            env.with_state_backend({"memory": "memory", "pebble": "disk"}[e.state.backend])
    if wf.source.type == "kafka":
        spec = kafka_source(wf)
        df = source if source is not None else spec.read(spark)
        k = wf.source.kafka
        if k.deserialize not in ("", "json"):
            raise CompileError(f'source.kafka.deserialize: unsupported deserializer "{k.deserialize}"')
        if k.deserialize == "json":
            df = df.where(J.decoded(F.col("value")).isNotNull())
        stream = env.from_source(df, name="kafka")
        if k.watermark:
            stream = stream.with_watermark(f"{k.watermark.maxOutOfOrderness.us}us")
    else:
        df = source if source is not None else inline(spark, [{"key": r.key, "value": r.value} for r in wf.source.records])
        stream = env.from_source(df, name=wf.source.type)
    stream = apply(stream, wf.pipeline, registry)
    if stream.windowed and "window" in stream.df.columns:
        stream = dataclasses.replace(stream, df=window_headers(stream.df))
    stream.to_sink(sink(wf, connect))
    asked = guarantee(wf)
    return Compiled(env, stream, asked, "at-least-once" if asked == "exactly-once" else asked, graph(wf))


__all__ = ["Compiled", "CompileError", "apply", "compile", "deserialize", "from_environment", "graph", "revealed", "text", "with_secrets"]
