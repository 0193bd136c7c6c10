import json

import pytest

from tidemill.workflow.compiler import CompileError, compile, folder, graph, revealed, safe_name, with_secrets
from tidemill.workflow.parse import ParseError, load, loads
from tidemill.workflow.runner import main
from tidemill.workflow.validate import ValidationError, guarantee, validate

ORDERS = """
name: order-totals
version: "1"
source:
  type: slice
  records:
    - {key: a, value: '{"customer":{"id":"c1"},"amount":10,"status":"completed"}'}
    - {key: b, value: '{"customer":{"id":"c1"},"amount":15,"status":"pending"}'}
    - {key: c, value: '{"customer":{"id":"c1"},"amount":5,"status":"completed"}'}
pipeline:
  - {id: done, type: filter, filter: {field: status, operator: equals, value: completed}}
  - {id: by, type: keyBy, keyBy: {field: customer.id, partitions: 4}}
  - {id: total, type: reduce, reduce: {function: sum, field: amount}}
sink: {type: blackhole}
"""

ONCE = """
name: once
env: {bufferSize: 100, shutdownTimeout: 30s, checkpointing: {interval: 30s, dir: ""}, state: {backend: memory}}
source:
  type: kafka
  kafka: {brokers: [b:9092], topic: orders, groupID: g, exactlyOnce: true, deserialize: json, watermark: {maxOutOfOrderness: 1s, interval: 500ms},
          sasl: {mechanism: scram-sha-256, username: "${USER_NAME}", password: "${SECRET}"}}
pipeline:
  - {id: by, type: keyBy, keyBy: {field: id}}
  - {id: w, type: window, window: {type: tumbling, size: 5m}}
  - {id: n, type: reduce, reduce: {function: count}}
sink:
  type: txnKafka
  txnKafka: {brokers: [b:9092], topic: out, transactionalID: t, serialize: json}
"""


def result(spark, text, source=None, **how):
    return compile(loads(text), spark, source=source, **how).stream.df


def test_orders(spark):
    rows = result(spark, ORDERS).orderBy("offset").collect()
    assert [(r.key, json.loads(r.value), r.offset) for r in rows] == [("c1", {"sum": 10}, 0), ("c1", {"sum": 15}, 2)]
    final = ORDERS.replace("field: amount", "field: amount, emit: final")
    assert [json.loads(r.value) for r in result(spark, final).collect()] == [{"sum": 15}]


def test_running_sums_in_windows_carry_their_bounds(spark):
    text = ORDERS.replace("  - {id: total", "  - {id: w, type: window, window: {type: tumbling, size: 1s}}\n  - {id: total")
    rows = result(spark, text).orderBy("offset").collect()
    assert [json.loads(r.value) for r in rows] == [{"sum": 10}, {"sum": 15}]
    assert rows[0].headers == {"window_start": "1970-01-01T00:00:00Z", "window_end": "1970-01-01T00:00:01Z"} and rows[0].partition is None


def test_undecodable_records(spark):
    text = """
name: odd
source: {type: slice, records: [{value: "not json"}, {value: '{"k":1.0,"v":"x"}'}, {value: '{"k":1,"v":2.5}'}, {value: '{"k":null}'}, {value: '{"k":true}'}]}
pipeline:
  - {id: s, type: setFields, setFields: {sets: [{field: m.n, value: 1}]}}
  - {id: r, type: renameFields, renameFields: {renames: [{from: m.n, to: q}]}}
  - {id: by, type: keyBy, keyBy: {field: k}}
  - {id: t, type: reduce, reduce: {function: %s}}
sink: {type: stdout}
"""
    keys = {r.key: json.loads(r.value) for r in result(spark, text % "sum, field: v").collect()}
    assert keys[""] == {"sum": 0} and keys["<nil>"] == {"sum": 0} and keys["true"] == {"sum": 0} and keys["1"]["sum"] in (0, 2.5)
    assert all(json.loads(r.value)["count"] >= 1 for r in result(spark, text % "count").collect())


@pytest.mark.parametrize(
    "change",
    [("name: order-totals", "nam: x"), ("{type: blackhole}", "{type: blackhole, more: 1}"), ("partitions: 4", "partitions: many"), ("  records:", "  records: 5\n  extra:"), ("name: order-totals", "name: a\nname: b"), ("name: order-totals", "name: [")],
)
def test_strict_parsing(change):
    with pytest.raises(ParseError):
        loads(ORDERS.replace(*change))


def test_durations_are_strings():
    with pytest.raises(ParseError, match="duration"):
        loads(ONCE.replace("size: 5m", "size: 5"))


def test_files(tmp_path, capsys):
    path = tmp_path / "f.yaml"
    path.write_text(ORDERS)
    assert load(str(path)) == loads(ORDERS)
    as_json = tmp_path / "f.json"
    as_json.write_text(json.dumps({"name": "x", "source": {"type": "slice"}, "sink": {"type": "stdout"}}))
    assert load(str(as_json)).name == "x"
    with pytest.raises(ParseError):
        load(str(tmp_path / "f.txt"))
    assert main(["--file", str(path), "--describe"]) == 0 and json.loads(capsys.readouterr().out)["delivery"] == "at-most-once"
    assert main(["--file", str(tmp_path / "none.yaml")]) == 1


def test_all_faults_at_once():
    text = """
name: "bad name"
version: "7"
env: {bufferSize: -1, checkpointing: {interval: 0s}, state: {backend: tape}}
source: {type: kafka, kafka: {parallel: true, groupID: g, watermark: {maxOutOfOrderness: 0s}}}
pipeline:
  - {type: filter, filter: {operator: near}}
  - {id: a, type: reduce, reduce: {function: avg}}
  - {id: a, type: window, window: {type: sliding, size: 5s, slide: 10s}}
  - {id: b, type: keyBy}
  - {id: c, type: map, filter: {field: x, operator: exists}}
  - {id: d, type: nothing}
  - {id: e, type: selectFields, selectFields: {fields: []}}
sink: {type: postgres, postgres: {mapping: {a: b}, mode: upsert, conflictColumns: [z], updateColumns: [y]}}
"""
    with pytest.raises(ValidationError) as e:
        validate(loads(text))
    said = str(e.value)
    for part in (
        "version: '7'", "name: 'bad name'", "env.bufferSize: -1", "env.checkpointing.interval", "env.state.backend: 'tape'", "source.kafka.brokers", "source.kafka.topic: neither", "source.kafka.parallel: can't", "source.kafka.watermark.maxOutOfOrderness",
        "pipeline[0]: it has no id", "pipeline[0].filter.field", "filter.operator: 'near'", "reduce.function: 'avg'", "no keyBy stands before this reduce", "its id is that of pipeline[1]", "slide: a slide longer", "no keyBy stands before this window",
        "a block keyBy and no other", "a block map and no other is needed; there: filter", "'nothing' is no type", "selectFields.fields", "sink.postgres.dsn", "sink.postgres.table", "conflictColumns: column 'z'", "updateColumns: column 'y'",
    ):
        assert part in said, part


def test_order_and_delivery():
    wf = loads(ONCE)
    validate(wf)
    assert guarantee(wf) == "exactly-once" and graph(wf)["delivery"] == "exactly-once"
    for change, part in ((("exactlyOnce: true", "exactlyOnce: false"), "kafka source"), (("type: txnKafka", "type: stdout"), "txnKafka"), (("checkpointing: {interval: 30s, dir: \"\"}, ", ""), "checkpointing")):
        with pytest.raises(ValidationError, match=part):
            validate(loads(ONCE.replace(*change)))
    late = loads(ORDERS + "")
    late.pipeline.append(loads(ONCE).pipeline[1])
    with pytest.raises(ValidationError, match="after the reduce of the same key"):
        validate(late)


def test_secrets():
    wf = with_secrets(loads(ONCE), {"USER_NAME": "u", "SECRET": "p"}.__getitem__)
    assert (wf.source.kafka.sasl.username, wf.source.kafka.sasl.password) == ("u", "p") and "p" not in repr(wf.source.kafka.sasl).split("username")[0]
    with pytest.raises(CompileError, match='secret "GONE"') as e:
        revealed("password", "${GONE}", {}.__getitem__)
    assert "hunter2" not in str(e.value)
    with pytest.raises(CompileError, match="syntax"):
        revealed("dsn", "${1x}", {}.__getitem__)
    assert revealed("dsn", "plain", {}.__getitem__) == "plain"


def test_kafka_workflow_compiles_over_a_given_table(spark, tmp_path):
    from tidemill.envelope import from_records, record

    rows = from_records(spark, [record('{"id":"a"}', offset=0), record("broken", offset=1), record('{"id":"a"}', offset=2)])
    text = ONCE.replace('dir: ""', f'dir: "{tmp_path}"')
    c = compile(loads(text), spark, {"USER_NAME": "u", "SECRET": "p"}.__getitem__, source=rows)
    assert (c.guarantee, c.delivered) == ("exactly-once", "at-least-once")
    assert [json.loads(r.value)["count"] for r in c.stream.df.orderBy("offset").collect()] == [1, 2]
    assert c.env.options["directory"] == str(tmp_path / "once")
    for change, part in ((("groupID: g", "groupID: ''"), "group id"), (("topic: orders, ", "topic: orders, parallel: true, "), "groupID")):
        with pytest.raises((CompileError, ValidationError), match=part):
            compile(loads(text.replace(*change)), spark, lambda _: "x", source=rows)


def test_refs_need_a_registry(spark):
    text = ORDERS.replace("pipeline:\n", "pipeline:\n  - {id: m, type: map, map: {ref: twice}}\n")
    with pytest.raises(CompileError, match="twice"):
        result(spark, text)
    assert result(spark, text, registry={"twice": lambda s: s}).count() == 2


def test_folders():
    assert safe_name(" a/b ") == "a_b" and safe_name("..") == "default"
    assert folder("", "root", "x", "state") == "root/x/state" and folder("/d", "root", "x", "state") == "/d/x"
