"""Supervision of one job: phases with a history, counters of its progress, and a small HTTP surface."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Phases and where each may lead.
PHASES = {
    "created": ("starting", "canceled"), "starting": ("running", "failed", "canceled"), "running": ("finished", "failed", "canceling"),
    "canceling": ("canceled", "failed"), "finished": (), "failed": (), "canceled": (),
}


class Metrics(StreamingQueryListener):
    """Counters of all queries of a session, in the text format of Prometheus."""

    def __init__(self) -> None:
        self.lock, self.values = threading.Lock(), {}

    def add(self, name: str, amount: float, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self.lock:
            self.values[key] = self.values.get(key, 0) + amount

    def put(self, name: str, value: float, **labels: str) -> None:
        with self.lock:
            self.values[name, tuple(sorted(labels.items()))] = value

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.add("queries_started_total", 1)

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.add("batches_total", 1, query=name)
        self.add("records_in_total", p.numInputRows, query=name)
        self.put("batch_duration_ms", p.batchDuration, query=name)
        for s in p.stateOperators:
            self.put("state_rows", s.numRowsTotal, query=name, operator=s.operatorName)
            self.add("late_records_total", s.numRowsDroppedByWatermark, query=name, operator=s.operatorName)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.add("queries_failed_total" if event.exception else "queries_finished_total", 1)

    def text(self) -> str:
        with self.lock:
            rows = sorted(self.values.items())
        return "".join(f"tidemill_{n}" + ("{" + ",".join(f"{k}={json.dumps(v)}" for k, v in labels) + "}" if labels else "") + f" {x:g}\n" for (n, labels), x in rows)


class JobAgent:
    """Runs ``start`` (which gives a query, or a result in batch) and follows it to its end."""

    def __init__(self, start: Callable[[], Any], describe: Callable[[], dict] = dict, plan: Callable[[], str] = lambda: "{}", savepoint: Callable[[str], str] | None = None, metrics: Metrics | None = None) -> None:
        self.start_job, self.describe, self.plan, self.savepoint, self.metrics = start, describe, plan, savepoint, metrics or Metrics()
        self.phase, self.error, self.history = "created", "", [("created", time.time())]
        self.query: StreamingQuery | None = None
        self.lock, self.done = threading.RLock(), threading.Event()

    def move(self, phase: str, error: str = "") -> bool:
        with self.lock:
            if phase not in PHASES[self.phase]:
                return False
            self.phase, self.error = phase, error
            self.history.append((phase, time.time()))
            if not PHASES[phase]:
                self.done.set()
            return True

    def run(self) -> None:
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        if not self.move("starting"):
            return
        try:
            out = self.start_job()
            self.query = out if hasattr(out, "awaitTermination") else None
            self.move("running")
            if self.query is not None:
                self.query.awaitTermination()
            self.move("canceled" if self.phase == "canceling" else "finished")
        except Exception as e:
            self.move("failed", str(e).splitlines()[0] if str(e) else type(e).__name__)

    def cancel(self) -> bool:
        if self.phase == "created":
            return self.move("canceled")
        if not self.move("canceling"):
            return False
        if self.query is not None:
            self.query.stop()
        return True

    def wait(self, timeout: float | None = None) -> bool:
        return self.done.wait(timeout)

    def state(self) -> dict[str, Any]:
        return {"phase": self.phase, "error": self.error, "history": [{"phase": p, "at": t} for p, t in self.history]}

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """/healthz /state /describe /plan /metrics by GET; /cancel and /savepoint?label= by POST."""
        agent = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_: Any) -> None:
                pass

            def answer(self, status: int, body: Any, kind: str = "application/json") -> None:
                data = (body if isinstance(body, str) else json.dumps(body)).encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:  # noqa: N802
                known = {"/healthz": lambda: {"ok": agent.phase != "failed"}, "/state": agent.state, "/describe": agent.describe, "/plan": agent.plan}
                if self.path == "/metrics":
                    self.answer(200, agent.metrics.text(), "text/plain; version=0.0.4")
                elif self.path in known:
                    self.answer(200, known[self.path]())
                else:
                    self.answer(404, {"error": "not found"})

            def do_POST(self) -> None:  # noqa: N802
                path, _, rest = self.path.partition("?")
                if path == "/cancel":
                    self.answer(202 if agent.cancel() else 409, agent.state())
                elif path == "/savepoint" and agent.savepoint:
                    try:
                        self.answer(200, {"savepoint": agent.savepoint(rest.removeprefix("label="))})
                    except Exception as e:
                        self.answer(409, {"error": str(e)})
                else:
                    self.answer(404, {"error": "not found"})

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


def retried(job: Callable[[], Any], tries: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Runs a job again after failures, waiting twice as long each time."""
    for turn in range(tries):
        try:
            return job()
        except Exception:
            if turn == tries - 1:
                raise
            sleep(min(most, first * 2**turn))
    raise AssertionError
