"""Rows for Postgres: the statements, the mapping of JSON fields to columns, and the writer around a driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_paths import decoded, get, kind, variant_path


def _quoted(name: str) -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


def statement(table: str, columns: Sequence[str], rows: int, mode: str = "insert", conflict: Sequence[str] = (), update: Sequence[str] = ()) -> str:
    """A multi-row INSERT with numbered places, or an upsert on ``conflict`` (by default all other columns change)."""
    check(mode, conflict, update)
    width = len(columns)
    groups = ",".join("(" + ",".join(f"${r * width + c + 1}" for c in range(width)) + ")" for r in range(rows))
    names = ",".join(map(_quoted, columns))
    sql = f"INSERT INTO {_quoted(table)} ({names}) VALUES {groups}"
    if mode == "insert":
        return sql
    changed = list(update) or [c for c in columns if c not in conflict]
    action = "UPDATE SET " + ",".join(f"{_quoted(c)}=EXCLUDED.{_quoted(c)}" for c in changed) if changed else "NOTHING"
    return f"{sql} ON CONFLICT ({','.join(map(_quoted, conflict))}) DO {action}"


def check(mode: str, conflict: Sequence[str], update: Sequence[str]) -> None:
    if mode not in ("insert", "upsert"):
        raise ValueError(f"unsupported postgres mode {mode!r} (insert or upsert)")
    if mode == "insert" and (conflict or update):
        raise ValueError("conflict/update columns require upsert mode")
    if mode == "upsert" and not conflict:
        raise ValueError("upsert requires at least one conflict column")


def mapped(df: DataFrame, mapping: dict[str, str], value: str = "value") -> DataFrame:
    """Columns by name from JSON fields: missing and null are NULL, nested values are JSON, scalars their text."""
    v = decoded(F.col(value))

    def one(path: str) -> Any:
        x = get(v, path)
        return F.when(kind(x).isin("object", "array"), F.to_json(x)).otherwise(F.get_json_object(value, variant_path(path)))

    return df.select("*", *(one(p).alias(c) for c, p in sorted((c, p) for p, c in mapping.items())))


def last_per_key(df: DataFrame, conflict: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Of rows with one conflict key the one that arrived last, as one statement can't touch a row twice.

    An aggregate, so map-side combining leaves one row a key and task before the exchange.
    """
    rest = [c for c in df.columns if c not in conflict]
    best = df.groupBy(*conflict).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("__row"))
    return best.select(*conflict, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def numbered(df: DataFrame, conflict: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Every row with its turn among those of its conflict key."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*conflict).orderBy(*arrival)))


@dataclass
class PostgresSink:
    """Writes batches through a DB-API connection that ``connect`` opens in each task (places as ``$n`` or ``%s``).

    A batch that fails after its retries ends the job (``on_error="fail"``) or is logged and left out (``"drop"``)."""

    connect: Callable[[], Any]
    table: str
    mapping: dict[str, str]
    mode: str = "insert"
    conflict: tuple[str, ...] = ()
    update: tuple[str, ...] = ()
    batch_size: int = 100
    max_retries: int = 3
    paramstyle: str = "format"
    on_error: str = "fail"
    name: str = "Postgres"

    def write(self, df: DataFrame) -> None:
        check(self.mode, self.conflict, self.update)
        columns = sorted(self.mapping.values())
        rows = mapped(df, self.mapping).select(*columns, "offset", "partition")
        if self.mode == "upsert":
            rows = last_per_key(rows, self.conflict, ["offset", "partition"])
        write = self._writer(columns)
        rows.select(*columns).foreachPartition(write)

    def _writer(self, columns: list[str]) -> Callable[[Iterator[Any]], None]:
        connect, how, size, retries, style, table, policy = self.connect, (self.mode, self.conflict, self.update), self.batch_size, self.max_retries, self.paramstyle, self.table, self.on_error

        def run(rows: Iterator[Any]) -> None:
            import contextlib
            import itertools
            import logging
            import re
            import time

            connection = None
            while batch := list(itertools.islice(rows, size)):
                sql = statement(table, columns, len(batch), *how)
                sql = re.sub(r"\$\d+", "%s", sql) if style == "format" else sql
                for turn in range(retries + 1):
                    try:
                        connection = connection or connect()
                        connection.cursor().execute(sql, [x for row in batch for x in row])
                        connection.commit()
                        break
                    except Exception as e:
                        with contextlib.suppress(Exception):
                            connection.close()
                        connection = None
                        if turn < retries:
                            time.sleep(min(30, 2**turn))
                        elif policy == "fail":
                            raise
                        else:
                            logging.getLogger(__name__).warning("%s rows for %s were dropped: %s", len(batch), table, type(e).__name__)
            if connection is not None:
                connection.close()

        return run
