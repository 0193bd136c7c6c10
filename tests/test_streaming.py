import json
import time
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.agent import JobAgent, Metrics, retried
from tidemill.functions import reducers as R
from tidemill.functions.windows import Session, Tumbling
from tidemill.operators.stream import StreamEnv
from tidemill.sources.readers import parquet, rate
from tidemill.streaming import savepoints
from tidemill.streaming.ledger import LedgerSink
from tidemill.streaming.stateful import idle_flush, strict_tumbling

BASE = datetime(2024, 1, 1)
SCHEMA = "key string, v long, timestamp timestamp, offset long"


def put(spark, folder, rows):
    """One file: one micro-batch."""
    data = [(k, v, BASE + timedelta(seconds=s), o) for k, v, s, o in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, sink, checkpoint, mode="append"):
    q = df.writeStream.foreachBatch(lambda b, n: sink.write_batch(b, n)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"


def test_running_reduce_gives_a_row_for_each_record(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("a", 1, 1, 0), ("b", 10, 2, 1), ("a", 2, 3, 2)])
    put(spark, inp, [("a", 4, 4, 3)])
    s = StreamEnv(spark).from_source(source(spark, inp), arrival=("offset",)).key_by("key").reduce(R.total("v"), R.count("n"))
    sink = LedgerSink(str(out), "q")
    drain(s.df, sink, ckpt)
    assert [(r.key, r.sum, r.n) for r in sink.read(spark).orderBy("offset").collect()] == [("a", 1, 1), ("b", 10, 1), ("a", 3, 2), ("a", 7, 3)]
    # Started again after more input, the state goes on where it was.
    put(spark, inp, [("a", 8, 5, 4)])
    drain(s.df, sink, ckpt)
    assert [r.sum for r in sink.read(spark).where("offset = 4").collect()] == [15]


def test_windows_with_a_watermark(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("k", 1, 1, 0), ("k", 2, 2, 1)])
    put(spark, inp, [("k", 10, 40, 2)])
    put(spark, inp, [("k", 7, 61, 3)])
    put(spark, inp, [("k", 5, 3, 4), ("k", 7, 62, 5)])  # the first is late: its window has fired
    s = StreamEnv(spark).from_source(source(spark, inp), arrival=("offset",)).with_watermark("5s").key_by("key")
    sink = LedgerSink(str(out), "q")
    drain(s.window_reduce(Tumbling("10s"), R.total("v")).df, sink, ckpt)
    assert sorted((r.window.start.second + 60 * r.window.start.minute, r.sum) for r in sink.read(spark).collect()) == [(0, 3), (40, 10)]
    with pytest.raises(ValueError):
        s.window(Session("5s"))


def test_windows_that_the_watermark_has_passed_are_evicted(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("k", 1, 1, 0), ("k", 2, 2, 1)])
    put(spark, inp, [("k", 4, 60, 2)])
    put(spark, inp, [("k", 8, 61, 3)])
    s = StreamEnv(spark).from_source(source(spark, inp), arrival=("offset",)).with_watermark("0s").key_by("key").window(Tumbling("10s")).reduce(R.count("n"))
    sink = LedgerSink(str(out), "q")
    q = drain(s.df, sink, ckpt)
    assert [(r.offset, r.n) for r in sink.read(spark).orderBy("offset").collect()] == [(0, 1), (1, 2), (2, 1), (3, 2)]
    kept = [o.numRowsTotal for o in q.lastProgress.stateOperators]
    assert kept and kept[-1] <= 3, kept  # one window and its timer, not two windows


def test_rows_set_aside_reach_the_sink_of_dead_letters(spark):
    class Kept:
        def __init__(self):
            self.rows = []

        def write(self, df):
            self.rows += df.collect()

    good, bad = Kept(), Kept()
    rows = spark.createDataFrame([("a", "1"), ("b", "x")], "key string, value string")
    env = StreamEnv(spark)
    env.from_source(rows, arrival=("key",)).process(F.expr("try_cast(value AS INT)"), F.expr("try_cast(value AS INT) IS NOT NULL"), F.lit("no number"), "dlq").to_sink(good)
    with pytest.raises(ValueError, match="with_dead_letters"):
        env.execute()
    env.with_dead_letters(bad).execute()
    assert [r.key for r in good.rows] == ["a"] and [(r.key, r._error) for r in bad.rows] == [("b", "no number")]


def test_strict_windows_drop_by_record(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("k", 1, 5, 0)])
    put(spark, inp, [("k", 2, 6, 1)])  # brings the watermark of the first batch, 5, into force
    put(spark, inp, [("k", 4, 3, 2), ("k", 8, 6, 3)])  # 3 is before it, though its window is open
    put(spark, inp, [("k", 16, 30, 4)])
    put(spark, inp, [("k", 32, 31, 5)])
    sink = LedgerSink(str(out), "q")
    drain(strict_tumbling(source(spark, inp).withWatermark("timestamp", "0 seconds"), "key", "timestamp", 10_000_000, "v"), sink, ckpt)
    assert [(r.n, r.total) for r in sink.read(spark).collect()] == [(3, 11.0)]


def test_idle_keys_flush(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("k", 1, 5, 0), ("k", 1, 6, 1)])
    sink = LedgerSink(str(out), "q")
    df = idle_flush(source(spark, inp), "key", 1_000)
    q = df.writeStream.foreachBatch(lambda b, n: sink.write_batch(b, n)).option("checkpointLocation", str(ckpt)).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not (rows := sink.read(spark, "key string, n long").collect()):
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.key, r.n) for r in rows] == [("k", 2)]


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["begin", "prepared", "marked", "committed"])
def test_every_record_once_after_a_crash(spark, folders, step):
    inp, out, ckpt = folders
    for b in range(3):
        put(spark, inp, [(f"key-{p}", b, b, p * 10 + b) for p in range(3)])
    crashed = []

    def hook(at, batch):
        if at == step and batch == 1 and not crashed:
            crashed.append(at)
            raise Crash(at)

    sink = LedgerSink(str(out), "q", hook)
    with pytest.raises(Exception, match=step):
        drain(source(spark, inp), sink, ckpt)
    drain(source(spark, inp), sink, ckpt)
    assert sorted((r.key, r.v) for r in sink.read(spark).collect()) == sorted((f"key-{p}", b) for p in range(3) for b in range(3))
    assert sink.was_committed(spark, 1) and not sink.was_committed(spark, 99)


def test_savepoints(spark, folders, tmp_path):
    inp, out, ckpt = folders
    put(spark, inp, [("a", 1, 1, 0)])
    df = StreamEnv(spark).from_source(source(spark, inp), arrival=("offset",)).key_by("key").reduce(R.total("v")).df
    drain(df, LedgerSink(str(out), "one"), ckpt)
    savepoints.create(spark, str(ckpt), str(tmp_path / "saved"), "v1")
    with pytest.raises(FileExistsError):
        savepoints.create(spark, str(ckpt), str(tmp_path / "saved"), "v1")
    with pytest.raises(ValueError):
        savepoints.create(spark, str(ckpt), str(tmp_path / "saved"), "../x")
    assert savepoints.labels(spark, str(tmp_path / "saved")) == ["v1"]
    put(spark, inp, [("a", 2, 2, 1)])
    drain(df, LedgerSink(str(out), "two"), ckpt)
    savepoints.restore(spark, str(tmp_path / "saved"), "v1", str(ckpt))
    sink = LedgerSink(str(out), "three")
    drain(df, sink, ckpt)
    assert [r.sum for r in sink.read(spark).collect()] == [3]


def test_sources(spark, folders):
    inp, _, _ = folders
    put(spark, inp, [("a", 1, 1, 0)])
    assert parquet(spark, str(inp)).count() == 1 and parquet(spark, str(inp), True, 1).isStreaming and rate(spark, 5).isStreaming


def test_failing_process(spark):
    df = spark.createDataFrame([("k", 1, BASE, 0), ("k", -1, BASE, 1)], SCHEMA)
    s = StreamEnv(spark).from_source(df, arrival=("offset",))
    assert s.process(F.col("v"), F.col("v") > 0).df.count() == 1
    assert s.process(F.col("v"), F.col("v") > 0, on_error="dlq").rejected[0].first()["_error"] == "process failed"
    with pytest.raises(Exception, match="negative"):
        s.process(F.col("v"), F.col("v") > 0, F.lit("negative"), on_error="fail").df.collect()
    with pytest.raises(ValueError):
        s.process(F.col("v"), F.col("v") > 0, on_error="ignore")


def test_env(spark, capsys):
    from tidemill.sinks.basic import Blackhole

    df = spark.createDataFrame([("k", 1, BASE, 0)], SCHEMA)
    env = StreamEnv(spark).with_buffer_size(10).with_shutdown_timeout("5s")
    with pytest.raises(ValueError):
        env.execute()
    env.from_source(df).map(v=F.col("v") + 1, label="plus").key_by("key").reduce(R.count("n"), mode="final").to_sink(Blackhole())
    assert env.execute() == 1
    said = json.loads(env.describe_json())
    assert [o["type"] for o in said["operators"]] == ["Map", "KeyBy", "Reduce"] and said["operators"][0]["label"] == "plus" and said["sink"]["type"] == "Blackhole"
    assert len(json.loads(env.plan_json())["nodes"]) == 4
    for bad in (lambda: env.with_buffer_size(0), lambda: env.with_checkpointing(0, "x"), lambda: env.with_state_backend("tape")):
        with pytest.raises(ValueError):
            bad()


def test_agent(spark, folders):
    inp, out, ckpt = folders
    put(spark, inp, [("a", 1, 1, 0)])
    metrics = Metrics()
    spark.streams.addListener(metrics)
    sink = LedgerSink(str(out), "q")
    start = lambda: source(spark, inp).writeStream.queryName("job").foreachBatch(lambda b, n: sink.write_batch(b, n)).option("checkpointLocation", str(ckpt)).start()
    agent = JobAgent(start, lambda: {"name": "job"}, lambda: "{}", metrics=metrics)
    server = agent.serve()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
    agent.run()
    end = time.time() + 60
    while time.time() < end and "records_in_total" not in metrics.text():
        time.sleep(0.3)
    assert json.loads(get("/healthz")) == {"ok": True} and json.loads(get("/state"))["phase"] == "running" and json.loads(get("/describe")) == {"name": "job"}
    assert 'tidemill_records_in_total{query="job"} 1' in get("/metrics")
    urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/cancel", method="POST"))
    assert agent.wait(60) and agent.phase == "canceled"
    assert [p for p, _ in agent.history] == ["created", "starting", "running", "canceling", "canceled"]
    server.shutdown()
    spark.streams.removeListener(metrics)
    failed = JobAgent(lambda: 1 / 0)
    failed.run()
    assert failed.wait(10) and failed.phase == "failed" and "zero" in failed.error


def test_retries():
    waits, tries = [], []

    def job():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert retried(job, sleep=waits.append) == "done" and waits == [2, 4]
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, tries=2, sleep=waits.append)
