"""Operators whose state Spark's aggregations can't keep: an output for every record, and record-level lateness.

Both run as ``transformWithStateInPandas`` and need the ``disk`` state backend. The rows of a key in a micro-batch are
sorted by arrival first, since a shuffle keeps no order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.reducers import Reducer
from .state import use_backend


class _Running(StatefulProcessor):
    """The accumulators after every record; with ``evict``, those of a window go when the watermark passes its end."""

    def __init__(self, arrival: list[str], reducers: Sequence[Reducer], kinds: list[str], windowed: bool, evict: bool) -> None:
        self.arrival, self.steps, self.names, self.kinds = arrival, [r.pairwise for r in reducers], [r.name for r in reducers], kinds
        self.windowed, self.evict = windowed, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reduce", ", ".join(f"a{i} {k}" for i, k in enumerate(self.kinds)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(self.arrival, kind="stable")
        acc = list(self.state.get()) if self.state.exists() else [None] * len(self.steps)
        out: list[list[Any]] = [[] for _ in acc]
        for row in batch.to_dict("records"):
            for i, step in enumerate(self.steps):
                acc[i] = step(acc[i], row)
                out[i].append(acc[i])
        if self.evict and not self.state.exists():
            self.handle.registerTimer(int(key[-1]) // 1000)
        self.state.update(tuple(acc))
        more = dict(zip(("_start_us", "_end_us"), key[-2:], strict=True)) if self.windowed else {}
        yield batch.assign(**dict(zip(self.names, out, strict=True)), **more)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _kinds(df: DataFrame, reducers: Sequence[Reducer]) -> list[str]:
    out = []
    for r in reducers:
        kind = df.groupBy().agg(r.final(F.struct(*df.columns[:1]))).dtypes[0][1]
        out.append({"bigint": "long"}.get(kind, kind))
    return out


def running_reduce(df: DataFrame, keys: list[str], arrival: list[str], reducers: Sequence[Reducer], evict: bool = False) -> DataFrame:
    """The accumulators after every record of a stream. ``evict``: the keys have a window and the stream a watermark."""
    if any(r.pairwise is None for r in reducers):
        raise ValueError("a running fold over a stream needs a pairwise step")
    use_backend(df.sparkSession, "disk")
    kinds = _kinds(df, reducers)
    if windowed := "window" in keys:  # states are kept by numbers
        columns = df.columns
        keys = [k for k in keys if k != "window"] + ["_start_us", "_end_us"]
        df = df.withColumns({"_start_us": F.unix_micros("window.start"), "_end_us": F.unix_micros("window.end")}).drop("window")
    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{r.name}` {k}" for r, k in zip(reducers, kinds, strict=True))).fields])
    out = df.groupBy(*keys).transformWithStateInPandas(_Running(arrival, reducers, kinds, windowed, evict), outputStructType=schema, outputMode="Append", timeMode="EventTime" if evict else "None")
    if not windowed:
        return out
    window = F.struct(F.timestamp_micros("_start_us").alias("start"), F.timestamp_micros("_end_us").alias("end"))
    return out.withColumn("window", window).select(*columns, *(r.name for r in reducers))


class _Strict(StatefulProcessor):
    """Counts and sums of tumbling windows; drops every record before the watermark, and fires at the window's end."""

    def __init__(self, key: str, ts: str, value: str | None, size: int, offset: int) -> None:
        self.key, self.ts, self.value, self.size, self.offset = key, ts, value, size, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("windows", "start long", "n long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            at = batch[self.ts].astype("datetime64[us, UTC]" if batch[self.ts].dt.tz is not None else "datetime64[us]").astype("int64")
            values = batch[self.value].fillna(0) if self.value else at * 0
            for t, v in zip(at, values, strict=True):
                if t < watermark:
                    continue
                start = (t - self.offset) // self.size * self.size + self.offset
                n, total = self.open.getValue((start,)) if self.open.containsKey((start,)) else (0, 0.0)
                if not n:
                    self.handle.registerTimer(-(-(start + self.size) // 1000))
                self.open.updateValue((start,), (n + 1, total + float(v)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (start,), (n, total) in list(self.open.iterator()):
            if -(-(start + self.size) // 1000) <= due:
                out.append((key[0], start, start + self.size, n, total))
                self.open.removeKey((start,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "start_us", "end_us", "n", "total"])

    def close(self) -> None:
        pass


def strict_tumbling(df: DataFrame, key: str, ts: str, size_us: int, value: str | None = None, offset_us: int = 0) -> DataFrame:
    """Tumbling windows of a stream (with ``withWatermark``) that drop late records one by one: key, start_us, end_us,
    n, total. Spark's own windows keep a late record as long as its window is open."""
    use_backend(df.sparkSession, "disk")
    kind = next(f for f in df.schema.fields if f.name == key)
    schema = StructType([kind, StructField("start_us", LongType()), StructField("end_us", LongType()), StructField("n", LongType()), StructField("total", DoubleType())])
    return df.groupBy(key).transformWithStateInPandas(_Strict(key, ts, value, size_us, offset_us), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Idle(StatefulProcessor):
    """Counts the records of a key and gives the count once nothing came for some time on the clock."""

    def __init__(self, key: str, timeout_ms: int) -> None:
        self.key, self.timeout = key, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("idle", "n long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, due = self.state.get() if self.state.exists() else (0, 0)
        if due:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.timeout
        self.handle.registerTimer(due)
        self.state.update((n + sum(map(len, rows)), due))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def idle_flush(df: DataFrame, key: str, timeout_us: int) -> DataFrame:
    """Per key, what has gathered when no record came for ``timeout_us``."""
    use_backend(df.sparkSession, "disk")
    kind = next(f for f in df.schema.fields if f.name == key)
    schema = StructType([kind, StructField("n", LongType())])
    return df.groupBy(key).transformWithStateInPandas(_Idle(key, max(1, timeout_us // 1000)), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
