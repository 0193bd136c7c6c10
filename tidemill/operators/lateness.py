"""Late records in batch: the limit of a watermark that follows every record.

A record is late if its event time lies before the largest event time that arrived earlier, less the allowed
lateness; equal is on time, and the first record never is late. The running maximum over arrival order is taken in two
steps, over ranges of the order and within each range, so that no task holds the whole table.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import micros

#: Rows of one range of the arrival order, about.
RANGE_ROWS = 1_000_000


def range_of(place: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` lie below ``place`` (none below null): bisection, in an expression of one size."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")  # folded into one constant
    widths = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(widths, F.lit(0), lambda at, w: F.when(F.get(held, at + w - 1) < place, at + w).otherwise(at))


def with_watermark_before(df: DataFrame, ts: str, arrival: list[str], lateness: str | int | timedelta, out: str = "watermark", ranges: int | None = None) -> DataFrame:
    """``df`` with the watermark that each record meets (null for the first)."""
    first = arrival[0]
    if ranges is None:
        ranges = max(1, math.ceil(df.count() / RANGE_ROWS))
    kind = dict(df.dtypes)[first]
    place = F.col(first).cast("double") if kind not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(first).cast("timestamp")).cast("double")
    df = df.withColumn("__place", place)
    # Cut points need not be exact: any rule that keeps the order of arrival will do.
    cuts = df.approxQuantile("__place", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    df = df.withColumn("__range", range_of(F.col("__place"), sorted(set(cuts))))
    within = Window.partitionBy("__range").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("__range").agg(F.max(ts).alias("__top"))
    before = F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("__range", before.alias("__before"))  # one row a range
    df = df.withColumn("__seen", F.max(ts).over(within)).join(tops, "__range")
    seen = F.greatest("__seen", "__before")
    return df.withColumn(out, seen - F.expr(f"interval {micros(lateness)} microseconds")).drop("__range", "__place", "__seen", "__before")


def split_late(df: DataFrame, ts: str, arrival: list[str], lateness: str | int | timedelta, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(on time, late) records."""
    marked = with_watermark_before(df, ts, arrival, lateness, "__watermark", ranges)
    late = F.coalesce(F.col(ts) < F.col("__watermark"), F.lit(False))
    return marked.where(~late).drop("__watermark"), marked.where(late).drop("__watermark")
