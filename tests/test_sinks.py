import gzip
import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.envelope import from_records, from_slices, record, to_envelope, with_headers
from tidemill.sinks.basic import Blackhole, FileDlq, KafkaSink, ObjectStore, Stdout, kafka_dlq
from tidemill.sinks.http import HttpSink, Permanent, json_array, ndjson, post
from tidemill.sinks.postgres import PostgresSink, last_per_key, mapped, statement
from tidemill.sources.kafka import KafkaSource, Sasl, Tls, records
from tidemill.sources.readers import deserialize, inline

AT = datetime(2023, 11, 14, 22, 13, 20, tzinfo=UTC)


@pytest.fixture
def letters(spark):
    return from_records(spark, [record('{"amount":42}', "user-7", AT, 99, 3, {"source": "orders"}), record("not json \"x\"", None, AT, 100)])


def test_statements():
    assert statement("orders", ["order_id", "amount"], 2) == 'INSERT INTO "orders" ("order_id","amount") VALUES ($1,$2),($3,$4)'
    three = ["order_id", "amount", "updated_at"]
    head = 'INSERT INTO "orders" ("order_id","amount","updated_at") VALUES ($1,$2,$3) ON CONFLICT ("order_id") DO UPDATE SET "amount"=EXCLUDED."amount"'
    assert statement("orders", three, 1, "upsert", ["order_id"]) == head + ',"updated_at"=EXCLUDED."updated_at"'
    assert statement("orders", three, 1, "upsert", ["order_id"], ["amount"]) == head
    assert statement("s.orders", ["order_id"], 1, "upsert", ["order_id"]) == 'INSERT INTO "s"."orders" ("order_id") VALUES ($1) ON CONFLICT ("order_id") DO NOTHING'
    for bad in (("insert", ["a"], []), ("upsert", [], []), ("merge", [], [])):
        with pytest.raises(ValueError):
            statement("t", ["a"], 1, *bad)


def test_mapping(spark):
    df = spark.createDataFrame([('{"customer_id":"c-1","payment":{"total":999999999999},"nested":{"obj":{"k":1}}}',)], "value string")
    row = mapped(df, {"payment.total": "total_amount", "customer_id": "customer_id", "nested.obj": "meta", "note": "note"}).drop("value").first()
    assert row.asDict() == {"customer_id": "c-1", "meta": '{"k":1}', "note": None, "total_amount": "999999999999"}


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 3, 1)], "k string, at int, v int")
    assert sorted(map(tuple, last_per_key(df, ["k"], ["at"]).collect())) == [("a", 2, 4), ("b", 3, 1)]


def test_stdout_and_blackhole(letters, capsys):
    assert Stdout().write(letters) == 2
    assert capsys.readouterr().out.splitlines()[0] == 'key=user-7 value={"amount":42} timestamp=2023-11-14T22:13:20Z offset=99'
    sink = Blackhole()
    assert sink.write(letters) == 2 and sink.count == 2


def test_dead_letters(letters, tmp_path):
    FileDlq(str(tmp_path / "dlq")).write(letters)
    rows = [json.loads(x) for f in (tmp_path / "dlq").glob("part-*") for x in f.read_text().splitlines()]
    first = next(r for r in rows if r["key"] == "user-7")
    assert {k: v for k, v in first.items() if k != "dlq_time"} == {"key": "user-7", "value": {"amount": 42}, "timestamp": int(AT.timestamp()) * 10**9, "offset": 99, "partition": 3, "headers": {"source": "orders"}}
    assert next(r for r in rows if r["key"] == "")["value"] == 'not json "x"'
    assert set(first) == {"dlq_time", "key", "value", "timestamp", "offset", "partition", "headers"}


def test_object_layout(letters, tmp_path):
    ObjectStore(str(tmp_path / "o"), compress=True).write(letters)
    files = list((tmp_path / "o" / "date=2023-11-14" / "hour=22").glob("*.gz"))
    assert sum(len(gzip.open(f).read().splitlines()) for f in files) == 2


def test_kafka_options(letters):
    sink = KafkaSink(("a:1", "b:2"), "t", sasl=Sasl("plain", "u", 'p"w'), tls=Tls(ca_file="/ca.pem"))
    o = sink.options()
    assert o["kafka.bootstrap.servers"] == "a:1,b:2" and o["kafka.acks"] == "1" and o["kafka.security.protocol"] == "SASL_SSL" and 'p\\"w' in o["kafka.sasl.jaas.config"]
    assert kafka_dlq(("a:1",), "d").options()["kafka.acks"] == "all"
    assert sink.rows(letters).dtypes == [("key", "string"), ("value", "string"), ("headers", "array<struct<key:string,value:binary>>")]
    source = KafkaSource(("a:1",), ("t",), "g", "latest", exactly_once=True)
    assert source.options()["kafka.isolation.level"] == "read_committed" and source.options()["startingOffsets"] == "latest"
    for bad in (KafkaSource((), ("t",)), KafkaSource(("a",), ()), KafkaSource(("a",), ("t",), "g", parallel=True), KafkaSource(("a",), ("t", "u"), parallel=True)):
        with pytest.raises(ValueError):
            bad.options()
    assert "p\"w" not in repr(sink)


def test_kafka_rows_become_records(spark):
    raw = spark.createDataFrame([(b"k", b"v", "t", 1, 7, AT, [("h", b"x")])], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key:string,value:binary>>")
    row = records(raw).first()
    assert (row.key, row.value, row.offset, row.headers) == ("k", "v", 7, {"h": "x"})


def test_deserialize(spark):
    df = inline(spark, [{"value": '{"id":"a","n":3}'}, {"value": "oops"}, {"value": '{"id":"b","n":"x"}'}])
    good, bad = deserialize(df, "id string, n int")
    assert [(r.parsed.id, r.parsed.n) for r in good.collect()] == [("a", 3)] and sorted(r.value for r in bad.collect()) == ["oops", '{"id":"b","n":"x"}'][::-1] or bad.count() == 2
    with pytest.raises(Exception, match="undecodable"):
        deserialize(df, "id string, n int", on_error="fail")[0].collect()
    with pytest.raises(ValueError):
        deserialize(df, "id string", on_error="skip")


def test_envelopes(spark):
    assert from_slices(spark, ["a", "b"], ["1", "2"]).orderBy("offset").first().value == "1"
    with pytest.raises(ValueError):
        from_slices(spark, ["a"], [])
    df = to_envelope(spark.createDataFrame([(1, AT, 5)], "user int, ts timestamp, id long"), "user", "ts", "id")
    assert df.first().key == "1" and json.loads(df.first().value)["id"] == 5
    assert with_headers(with_headers(df, a="1", b="2"), b=F.lit("3")).first().headers == {"a": "1", "b": "3"}


class Server:
    def __init__(self, answers):
        self.bodies, answers = [], list(answers)
        lock, bodies = threading.Lock(), self.bodies

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_POST(self):  # noqa: N802
                body = self.rfile.read(int(self.headers["Content-Length"]))
                with lock:
                    status, headers = answers.pop(0) if answers else (200, {})
                    bodies.append(body.decode())
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/"


def test_http(spark, letters, tmp_path):
    s = Server([])
    HttpSink(s.url, batch_size=1).write(letters.coalesce(1))
    assert sorted(s.bodies) == sorted(['{"amount":42}\n', 'not json "x"\n'])
    HttpSink(s.url, json_array).write(letters.coalesce(1))
    assert json.loads(s.bodies[-1]) == [{"amount": 42}, 'not json "x"']
    waits = []
    assert post(Server([(503, {}), (429, {"Retry-After": "7"})]).url, b"x", "t", {}, 5, 3, sleep=waits.append) == 3 and waits == [1, 7]
    with pytest.raises(Permanent):
        post(Server([(400, {})]).url, *ndjson(["x"]), {}, 5, 3)
    with pytest.raises(Exception, match="503"):
        post(Server([(503, {})] * 2).url, *ndjson(["x"]), {}, 5, 1, sleep=waits.append)
    with pytest.raises(Exception, match="status 400"):
        HttpSink(Server([(400, {})] * 9).url, on_error="fail").write(letters.coalesce(1))
    HttpSink(Server([(400, {})] * 9).url, on_error="dlq", dlq=FileDlq(str(tmp_path / "d"))).write(letters.coalesce(1))
    assert sum(len(f.read_text().splitlines()) for f in Path(tmp_path / "d").glob("part-*")) == 2


def test_postgres_failure_policies():
    opened = []

    class Connection:
        def __init__(self):
            self.rows = []
            opened.append(self)

        def cursor(self):
            return self

        def execute(self, sql, values):
            if "bad" in values:
                raise RuntimeError("refused")
            self.rows += values

        def commit(self):
            pass

        def close(self):
            pass

    rows = [("a",), ("bad",), ("b",)]
    how = {"connect": Connection, "table": "t", "mapping": {"x": "x"}, "batch_size": 1, "max_retries": 0}
    PostgresSink(**how, on_error="drop")._writer(["x"])(iter(rows))
    assert [c.rows for c in opened] == [["a"], ["b"]]  # a connection is kept until it fails
    with pytest.raises(RuntimeError, match="refused"):
        PostgresSink(**how)._writer(["x"])(iter(rows))
