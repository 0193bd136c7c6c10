"""Records to an HTTP endpoint, in batches, from every partition."""

from __future__ import annotations

import itertools
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class Permanent(RuntimeError):
    """An answer that trying again won't change."""


def ndjson(values: list[str]) -> tuple[bytes, str]:
    return "".join(v + "\n" for v in values).encode(), "application/x-ndjson"


def json_array(values: list[str]) -> tuple[bytes, str]:
    def one(v: str) -> Any:
        try:
            return json.loads(v)
        except ValueError:
            return v

    return json.dumps([one(v) for v in values]).encode(), "application/json"


def post(url: str, body: bytes, kind: str, headers: dict[str, str], timeout: float, retries: int, method: str = "POST", sleep: Callable[[float], None] = time.sleep) -> int:
    """The number of tries it took. 429, 5xx and network errors are tried again, after Retry-After if it is given."""
    for turn in range(retries + 1):
        wait = float(min(30, 2**turn))
        try:
            request = urllib.request.Request(url, body, {"Content-Type": kind, **headers}, method=method)
            with urllib.request.urlopen(request, timeout=timeout):
                return turn + 1
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise Permanent(f"status {e.code}") from e
            after = e.headers.get("Retry-After", "")
            wait = float(after) if after.isdigit() else wait
            if turn == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if turn == retries:
                raise
        sleep(wait)
    raise AssertionError


@dataclass
class HttpSink:
    url: str
    encode: Callable[[list[str]], tuple[bytes, str]] = ndjson
    batch_size: int = 100
    timeout: float = 30.0
    max_retries: int = 0
    on_error: str = "drop"
    headers: dict[str, str] = field(default_factory=dict)
    name: str = "HTTP"
    dlq: Any = None

    def write(self, df: DataFrame) -> DataFrame | None:
        """Sends all records; those that couldn't be sent are dropped, given to the DLQ, or end the job."""
        if self.on_error not in ("drop", "dlq", "fail") or self.on_error == "dlq" and self.dlq is None:
            raise ValueError(f"unsupported failure policy {self.on_error!r}")
        size, encode, url, fail = self.batch_size, self.encode, self.url, self.on_error == "fail"
        how = (dict(self.headers), self.timeout, self.max_retries)

        def run(rows: Iterator[Any]) -> Iterator[Any]:
            while batch := list(itertools.islice(rows, size)):
                try:
                    post(url, *encode([r.value for r in batch]), *how)
                except Exception:
                    if fail:
                        raise
                    yield from batch

        if self.on_error == "dlq":
            # A second pass would send twice: the failed are kept where the first left them.
            failed = df.sparkSession.createDataFrame(df.rdd.mapPartitions(run), df.schema).persist()
            self.dlq.write(failed)
            failed.unpersist()
        else:
            df.foreachPartition(lambda rows: [None for _ in run(rows)])
        return None
