"""The fluent builder: a lazy list of operators over a DataFrame, batch or streaming.

Every call adds columns or plan nodes at once, so the plan Spark sees is the whole pipeline and Catalyst optimises
across operators. ``key_by`` names the key, windows and reducers use it, and consecutive operators on one key share
one exchange.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durations import interval, micros, text
from ..functions.reducers import Reducer
from ..functions.windows import Assigner, Session
from .lateness import split_late

DEFAULT_PARTITIONS = 16


@dataclass(frozen=True)
class Op:
    """What an operator is, for descriptions and plans."""

    type: str
    label: str = ""
    config: dict[str, Any] = field(default_factory=dict)
    parallelism: int = 1
    cloneable: bool = True


class ProcessError(RuntimeError):
    pass


@dataclass(frozen=True)
class Stream:
    env: StreamEnv
    df: DataFrame
    key: str = "key"
    ts: str = "timestamp"
    arrival: tuple[str, ...] = ("offset", "partition")
    windowed: bool = False
    assigner: Assigner | None = None
    lateness: str | int | timedelta | None = None
    ops: tuple[Op, ...] = ()
    rejected: tuple[DataFrame, ...] = ()

    def _then(self, df: DataFrame, op: Op, **changes: Any) -> Stream:
        return replace(self, df=df, ops=(*self.ops, op), **changes)

    def apply(self, df: DataFrame, kind: str, label: str = "") -> Stream:
        """The stream over another DataFrame made of this one's."""
        return self._then(df, Op(kind, label))

    # -- records ---------------------------------------------------------------------------------------------------

    def map(self, *columns: Column, label: str = "", **named: Column) -> Stream:
        """One row for each: either exactly these columns, or all and these."""
        df = self.df.select(*columns) if columns else self.df
        return self._then(df.withColumns(named) if named else df, Op("Map", label))

    def flat_map(self, items: Column, name: str = "value", label: str = "") -> Stream:
        """A row for each item of an array column; none for an empty or null one."""
        return self._then(self.df.withColumn(name, F.explode(items)), Op("FlatMap", label))

    def filter(self, predicate: Column, label: str = "") -> Stream:
        return self._then(self.df.where(predicate), Op("Filter", label))

    def process(self, result: Column, ok: Column, error: Column | None = None, on_error: str = "drop", name: str = "value", label: str = "") -> Stream:
        """A fallible map: rows that aren't ``ok`` are dropped, set aside with an ``_error`` (``dlq``), or end the job (``fail``)."""
        if on_error not in ("drop", "dlq", "fail"):
            raise ValueError(f"unsupported failure policy {on_error!r}")
        good = F.coalesce(ok, F.lit(False))
        why = error if error is not None else F.lit("process failed")
        op = Op("Process", label, {"onError": on_error})
        if on_error == "fail":
            checked = F.when(good, result).otherwise(F.raise_error(why.cast("string")))
            return self._then(self.df.withColumn(name, checked), op)
        out = self._then(self.df.where(good).withColumn(name, result), op)
        if on_error == "dlq":
            bad = self.df.where(~good).withColumn("_error", why.cast("string"))
            return replace(out, rejected=(*self.rejected, bad))
        return out

    def map_in_pandas(self, function: Callable, schema: str, label: str = "") -> Stream:
        """For logic that columns can't express: a function from batches to batches."""
        return self._then(self.df.mapInPandas(function, schema), Op("Map", label))

    # -- keys ------------------------------------------------------------------------------------------------------

    def key_by(self, key: str | Column, partitions: int | None = None, label: str = "") -> Stream:
        """Names the key (a null one is the empty key). Rows move only when an operator needs them together."""
        if partitions is not None and partitions <= 0:
            raise ValueError("partitions must be greater than zero")
        n = partitions or DEFAULT_PARTITIONS
        df = self.df
        if isinstance(key, Column):
            df, key = df.withColumn("key", F.coalesce(key.cast("string"), F.lit(""))), "key"
        return self._then(df, Op("KeyBy", label, {"partitions": n}), key=key)

    def with_partitions(self, n: int) -> Stream:
        """Spreads rows over ``n`` partitions by the key; only right after ``key_by``, otherwise nothing changes."""
        if n <= 0:
            raise ValueError("partitions must be greater than zero")
        if not self.ops or self.ops[-1].type != "KeyBy":
            return self
        op = replace(self.ops[-1], config={"partitions": n})
        return replace(self, df=self.df.repartition(n, self.key), ops=(*self.ops[:-1], op))

    def with_parallelism(self, n: int) -> Stream:
        """A hint that stays in the description: Spark sizes stages by their data."""
        if n <= 0:
            raise ValueError("parallelism must be greater than zero")
        return replace(self, ops=(*self.ops[:-1], replace(self.ops[-1], parallelism=n))) if self.ops else self

    # -- time ------------------------------------------------------------------------------------------------------

    def with_watermark(self, lateness: str | int | timedelta) -> Stream:
        """Bounded out-of-orderness. Streaming uses Spark's watermark; batch drops, in front of windows, what a
        watermark that follows every record would."""
        if self.df.isStreaming:
            return replace(self, df=self.df.withWatermark(self.ts, interval(micros(lateness))), lateness=lateness)
        return replace(self, lateness=lateness)

    def _on_time(self) -> DataFrame:
        if self.lateness is None or self.df.isStreaming:
            return self.df
        return split_late(self.df, self.ts, list(self.arrival), self.lateness)[0]

    def late(self) -> DataFrame:
        """Records that a window at this place drops (batch)."""
        return split_late(self.df, self.ts, list(self.arrival), self.lateness or 0)[1] if self.lateness is not None else self.df.limit(0)

    def window(self, assigner: Assigner, label: str = "") -> Stream:
        """Every record once for each of its windows, in a ``window`` column; no rows are gathered but for sessions."""
        df = self._on_time()
        if isinstance(assigner, Session):
            if df.isStreaming:
                raise ValueError("sessions of single records need batch; reduce them with window_reduce")
            df = assigner.rows(df, self.key, self.ts, "window")
        else:
            df = df.withColumn("window", assigner.column(F.col(self.ts)))
        return self._then(df, Op("Window", label, _described(assigner)), windowed=True, assigner=assigner)

    # -- aggregation -----------------------------------------------------------------------------------------------

    def _arrival(self) -> Column:
        return F.struct(*self.arrival)

    def reduce(self, *reducers: Reducer, mode: str = "running", label: str = "") -> Stream:
        """``running``: the accumulator after every record, in arrival order (per key and, after ``window``, per
        window). ``final``: one row a group, with partial aggregation before the exchange."""
        keys = [self.key, "window"] if self.windowed else [self.key]
        op = Op("Reduce", label, {"mode": mode})
        if mode == "final":
            return self._then(self.df.groupBy(*keys).agg(*(r.final(self._arrival()) for r in reducers)), op)
        if mode != "running":
            raise ValueError(f"unsupported mode {mode!r}")
        if self.df.isStreaming:
            from ..streaming.stateful import running_reduce

            return self._then(running_reduce(self.df, keys, list(self.arrival), reducers, evict=self.windowed and self.lateness is not None), op)
        parts = [self.key, "window.start", "window.end"] if self.windowed else [self.key]
        spec = Window.partitionBy(*parts).orderBy(*self.arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._then(self.df.withColumns({r.name: r.running(spec, self._arrival()) for r in reducers}), op)

    def window_reduce(self, assigner: Assigner, *reducers: Reducer, keep: tuple[str, ...] = (), label: str = "") -> Stream:
        """One row for each key and window. ``keep`` names columns taken from the record that arrived last."""
        df = self._on_time()
        aggs = [r.final(self._arrival()) for r in reducers]
        if keep:
            aggs.append(F.max_by(F.struct(*keep), self._arrival()).alias("__last"))
        df = df.groupBy(self.key, assigner.column(F.col(self.ts)).alias("window")).agg(*aggs)
        if isinstance(assigner, Session):
            df = df.withColumn("window", assigner.restored(F.col("window")))
        if keep:
            df = df.select("*", *(F.col(f"__last.{c}").alias(c) for c in keep)).drop("__last")
        return self._then(df, Op("WindowReduce", label, _described(assigner)), windowed=True, assigner=assigner)

    # -- ends ------------------------------------------------------------------------------------------------------

    def to_sink(self, sink: Any) -> StreamEnv:
        self.env.sink, self.env.result = sink, self
        return self.env

    def label(self, label: str) -> Stream:
        return replace(self, ops=(*self.ops[:-1], replace(self.ops[-1], label=label))) if self.ops else self

    def plan(self) -> list[dict[str, Any]]:
        return stages(self.ops)


def _described(a: Assigner) -> dict[str, Any]:
    return {"type": type(a).__name__.lower(), **{k: text(micros(v)) for k, v in vars(a).items() if micros(v)}}


def stages(ops: tuple[Op, ...]) -> list[dict[str, Any]]:
    """Operators grouped as they run together: a keyed stage takes what follows its ``KeyBy`` and needs the key;
    neighbours without a key and of one parallelism share a stage."""
    out: list[dict[str, Any]] = [{"kind": "source", "ops": []}]
    for op in ops:
        now = out[-1]
        keyed = op.type in ("Window", "Reduce", "WindowReduce")
        if op.type == "KeyBy":
            out.append({"kind": "keyed", "ops": ["KeyBy"], "parallelism": op.config["partitions"]})
        elif keyed and now["kind"] == "keyed":
            now["ops"].append(op.type)
        elif keyed:
            out.append({"kind": "single", "ops": [op.type], "parallelism": 1})
        elif now["kind"] == "stateless" and now["parallelism"] == op.parallelism:
            now["ops"].append(op.type)
        else:
            out.append({"kind": "stateless", "ops": [op.type], "parallelism": op.parallelism})
    return [*out, {"kind": "sink", "ops": []}]


class StreamEnv:
    """One source, a list of operators, one sink, and how the query runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.source: Any = None
        self.sink: Any = None
        self.result: Stream | None = None
        self.dead_letters: Any = None
        self.options: dict[str, Any] = {"shutdown_timeout": 30_000_000}

    def from_source(self, df: DataFrame, key: str = "key", ts: str = "timestamp", arrival: tuple[str, ...] = ("offset", "partition"), name: str = "table") -> Stream:
        self.source = name
        return Stream(self, df, key, ts, arrival)

    def with_checkpointing(self, interval_: str | int | timedelta, directory: str) -> StreamEnv:
        if micros(interval_) <= 0:
            raise ValueError("checkpoint interval must be greater than zero")
        self.options |= {"interval": micros(interval_), "directory": directory}
        return self

    def with_shutdown_timeout(self, timeout: str | int | timedelta) -> StreamEnv:
        self.options["shutdown_timeout"] = micros(timeout)
        return self

    def with_buffer_size(self, size: int) -> StreamEnv:
        """Rows of a micro-batch at most, where the source takes such a limit."""
        if size <= 0:
            raise ValueError("buffer size must be greater than zero")
        self.options["buffer_size"] = size
        return self

    def with_state_backend(self, backend: str) -> StreamEnv:
        """``memory`` or ``disk`` (RocksDB, with changelog checkpoints)."""
        from ..streaming.state import use_backend

        use_backend(self.spark, backend)
        self.options["state"] = backend
        return self

    def with_listener(self, listener: Any) -> StreamEnv:
        self.spark.streams.addListener(listener)
        return self

    def with_dead_letters(self, sink: Any) -> StreamEnv:
        """Where rows go that ``process`` sets aside (``dlq``), with their ``_error``."""
        self.dead_letters = sink
        return self

    def execute(self) -> Any:
        """Runs the pipeline into its sink: at once in batch, as a ``StreamingQuery`` otherwise. What ``process`` sets
        aside goes to the sink of dead letters, in streams by queries of their own."""
        if self.result is None or self.sink is None:
            raise ValueError("the pipeline has no source or no sink")
        if self.result.rejected and self.dead_letters is None:
            raise ValueError("process sets rows aside, and there is no sink for them: see with_dead_letters")
        for i, bad in enumerate(self.result.rejected):
            self._run(bad, self.dead_letters, f"rejected-{i}")
        return self._run(self.result.df, self.sink)

    def _run(self, df: DataFrame, sink: Any, beside: str = "") -> Any:
        if not df.isStreaming:
            return sink.write(df)
        writer = df.writeStream.foreachBatch(lambda batch, n: sink.write_batch(batch, n) if hasattr(sink, "write_batch") else sink.write(batch))
        if "directory" in self.options:
            folder = self.options["directory"] + (f"-{beside}" if beside else "")
            writer = writer.option("checkpointLocation", folder).trigger(processingTime=f"{self.options['interval'] // 1000} milliseconds")
        return writer.outputMode("append").start()

    def describe(self) -> dict[str, Any]:
        ops = self.result.ops if self.result else ()
        out: dict[str, Any] = {
            "source": {"type": str(self.source)},
            "operators": [{"type": o.type, **({"label": o.label} if o.label else {}), **({"config": o.config} if o.config else {})} for o in ops],
            "sink": {"type": getattr(self.sink, "name", type(self.sink).__name__) if self.sink is not None else "Unknown"},
        }
        if "directory" in self.options:
            out["checkpoint"] = {"interval": text(self.options["interval"]), "storage": self.options["directory"]}
        return out

    def describe_json(self) -> str:
        return json.dumps(self.describe(), indent=2)

    def plan_json(self) -> str:
        if self.result is None:
            return "{}"
        nodes = stages(self.result.ops)
        edges = [{"from": i, "to": i + 1} for i in range(len(nodes) - 1)]
        return json.dumps({"nodes": nodes, "edges": edges}, indent=2)
