"""Window assigners: tumbling, sliding and session, aligned to the epoch, half open, in microseconds.

Differences kept on purpose: timestamps before the epoch get the window that contains them, and a slide over the size
is refused. Sessions merge on strict overlap only: an event exactly one gap after another begins a new session.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durations import interval, micros


class Assigner:
    is_session = False

    def column(self, ts: Column) -> Column:
        raise NotImplementedError

    def key(self, ts: Column) -> Column:
        """The grouping column of a streaming or final aggregation."""
        return self.column(ts)


@dataclass(frozen=True)
class Tumbling(Assigner):
    size: str | int | timedelta
    offset: str | int | timedelta = 0

    def __post_init__(self) -> None:
        if micros(self.size) <= 0:
            raise ValueError("window size must be greater than zero")

    def with_offset(self, offset: str | int | timedelta) -> Tumbling:
        return Tumbling(self.size, offset)

    def column(self, ts: Column) -> Column:
        size = micros(self.size)
        return F.window(ts, interval(size), startTime=interval(micros(self.offset) % size))


@dataclass(frozen=True)
class Sliding(Assigner):
    size: str | int | timedelta
    slide: str | int | timedelta
    offset: str | int | timedelta = 0

    def __post_init__(self) -> None:
        if micros(self.size) <= 0:
            raise ValueError("window size must be greater than zero")
        if micros(self.slide) <= 0:
            raise ValueError("window slide must be greater than zero")
        if micros(self.slide) > micros(self.size):
            raise ValueError("window slide must be less than or equal to size")

    def with_offset(self, offset: str | int | timedelta) -> Sliding:
        return Sliding(self.size, self.slide, offset)

    def column(self, ts: Column) -> Column:
        slide = micros(self.slide)
        return F.window(ts, interval(micros(self.size)), interval(slide), interval(micros(self.offset) % slide))


@dataclass(frozen=True)
class Session(Assigner):
    gap: str | int | timedelta
    is_session = True

    def __post_init__(self) -> None:
        if micros(self.gap) <= 0:
            raise ValueError("session gap must be greater than zero")

    def column(self, ts: Column) -> Column:
        """Spark's sessions also merge when they touch: with a gap less by one microsecond they don't."""
        return F.session_window(ts, interval(micros(self.gap) - 1))

    def restored(self, window: Column) -> Column:
        """The window of ``column`` with the microsecond given back to its end."""
        return F.struct(window.start.alias("start"), (window.end + F.expr("interval 1 microsecond")).alias("end"))

    def rows(self, df: DataFrame, key: str, ts: str, out: str) -> DataFrame:
        """Every row with its session, by gaps and islands: two sorts of one exchange on the key."""
        gap = F.expr(f"interval {micros(self.gap)} microseconds")
        order = Window.partitionBy(key).orderBy(ts)
        before = F.lag(ts).over(order)
        df = df.withColumn("__new", (before.isNull() | (F.col(ts) >= before + gap)).cast("int"))
        df = df.withColumn("__island", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        whole = Window.partitionBy(key, "__island")
        window = F.struct(F.min(ts).over(whole).alias("start"), (F.max(ts).over(whole) + gap).alias("end"))
        return df.withColumn(out, window).drop("__new", "__island")


def merge_sessions(a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> tuple[datetime, datetime] | None:
    """The union of two sessions that overlap strictly, else None."""
    return (min(a[0], b[0]), max(a[1], b[1])) if a[0] < b[1] and b[0] < a[1] else None
