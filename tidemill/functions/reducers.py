"""Keyed folds as native aggregates. Each gives an aggregate (one row a group) and a running column (one a record)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Reducer:
    name: str
    make: Callable[[Column], Column]  # of the arrival order
    pairwise: Callable | None = None  # (accumulator or None, row) -> accumulator, for stateful streaming

    def final(self, arrival: Column) -> Column:
        return self.make(arrival).alias(self.name)

    def running(self, spec: WindowSpec, arrival: Column) -> Column:
        return self.make(arrival).over(spec).alias(self.name)


def count(name: str = "count") -> Reducer:
    return Reducer(name, lambda _: F.count(F.lit(1)), lambda acc, _: (acc or 0) + 1)


def total(value: str | Column, name: str = "sum", kind: str | None = None) -> Reducer:
    """Sum; what is no number adds nothing. ``kind`` casts each value first, such as to a decimal for exact sums."""

    def make(_: Column) -> Column:
        col = F.col(value) if isinstance(value, str) else value
        return F.sum(F.coalesce(col.cast(kind) if kind else col, F.lit(0)))

    return Reducer(name, make, (lambda acc, row: (acc or 0) + (row[value] or 0)) if isinstance(value, str) else None)


def least(value: str, name: str = "min") -> Reducer:
    return Reducer(name, lambda _: F.min(value), lambda acc, row: row[value] if acc is None else min(acc, row[value]))


def most(value: str, name: str = "max") -> Reducer:
    return Reducer(name, lambda _: F.max(value), lambda acc, row: row[value] if acc is None else max(acc, row[value]))


def last(value: str, name: str = "last") -> Reducer:
    """The value of the record that arrived last."""
    return Reducer(name, lambda arrival: F.max_by(value, arrival), lambda _, row: row[value])


def fold(values: list[str], init: Column, step: Callable[[Column, Column], Column], name: str, finish: Callable[[Column], Column] | None = None) -> Reducer:
    """Any fold written with columns, over the group's rows in arrival order. It keeps a group's values in memory:
    use it where groups are windows of bounded size."""

    def make(arrival: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(arrival.alias("__at"), *values)))
        return F.aggregate(rows, init, step, finish) if finish else F.aggregate(rows, init, step)

    return Reducer(name, make)
